"""Suffix-array dedup: bytes covered by a long string that also starts earlier are removed.

A byte goes where a string of LENGTH bytes that covers it also starts at an earlier place (a smaller doc_id, or
earlier in the same document). All windows of LENGTH bytes are judged, on the texts as given:

1. Seeds. Each window is named by the smallest hash among the seeds (strings of SEED bytes) in it, the leftmost of
   equals, so equal windows have equal seeds at equal offsets. A stretch is a run of windows named by one seed's
   occurrence: a few dozen windows, told by the seed's and the stretch's hash, document, start and size.
2. Stretches meet by seed, packed by the thousand. Equal stretches fold, first within a task and then among all:
   the first stays, each later one is repeated as a whole. A seed with one stretch left has nothing repeated. Only
   different stretches of one seed, the edges of what repeats, go on.
3. Their bytes are fetched, and blocks of whole seeds are indexed by a suffix array and its Burrows-Wheeler
   transform. Breadth-first backward extension from the interval of all suffixes gives the common prefixes by
   increasing length: an interval whose right end is new at length l means that the suffixes on both sides of that
   end share exactly l bytes. It stops at LENGTH: ends never met share that much, and what lies between ends that
   were met is a class of equal windows. All but a class's first window are repeated.
4. Repeated windows of a document, overlapping or not, are merged to spans and cut out.

Seeds that a sample shows to be in very many stretches (a line that a third of all documents hold) would bring all of
them into one task. Their windows are named by the whole window instead: equal ones fold before they are shuffled,
and different ones part. The sample only says which seeds are worth that; results are the same for any.

Defined results: a null text is empty; texts under LENGTH bytes stay whole; rows with a null doc_id stay whole and
nothing is removed for them. Rows that repeat id and text are one document: each returns the same. Rows that repeat
an id with another text are documents of their own, in the order of their texts' digests. Stretches are equal where two
64-bit hashes and their sizes are. Other columns are not read.
"""

from __future__ import annotations

import gc
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from galley.llm import words as w
from galley.llm.common import discard, empty, materialize
from galley.tables import table

LENGTH, SEED = 100, 32
#: Documents of which one in so many tells what seeds are frequent; stretches from which on a seed is, at least, and
#: as a share of all stretches, so that there are at most a million such seeds.
SAMPLED, FREQUENT, SHARE = 64, 4096, 1_000_000
#: Bytes of text whose stretches a task packs together; of packed stretches a task folds; of texts a block indexes.
PACK, FOLD, INDEX = 8 << 20, 12 << 20, 1 << 20

ENTRY = np.dtype([("seed", "<u8"), ("hash", "<u8"), ("doc", "<i8"), ("start", "<i4"), ("size", "<i4")])
PACKED = "bucket int, settled boolean, body binary"
FOUND = "doc_id bigint, span bigint, seed bigint"


def _runs(first: np.ndarray, same: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(starts, ends) of runs of positions: ``first`` where one may begin, ``same`` where a position goes on from the one before."""
    starts = first & ~same
    ends = first & ~np.append(same[1:], False)
    return np.flatnonzero(starts), np.flatnonzero(ends)


def stretches(data: np.ndarray, offsets: np.ndarray, length: int, seed: int, frequent: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(entries, whose start is a place in ``data``; the text of each)."""
    n = len(data)
    windows = n - length + 1
    if windows <= 0:
        return np.zeros(0, ENTRY), np.zeros(0, np.int64)
    with np.errstate(over="ignore"):
        back = w._power(w._P_INV, n)
        sums = np.zeros(n + 1, np.uint64)
        np.cumsum(w._BYTES[data] * w._power(w._P, n)[:n], out=sums[1:])
        least = w.mix((sums[seed:] - sums[:-seed]) * back[: n - seed + 1])
        named, at, span, among = least, np.arange(len(least)), 1, length - seed + 1
        while span < among:  # the smallest of each window's seeds, by doubling
            step = min(span, among - span)
            right = named[step:] < named[:-step]
            at = np.where(right, at[step:], at[:-step])
            named = np.where(right, named[step:], named[:-step])
            span += step
        text = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
        inside = text[:windows] == text[length - 1 :]
        goes_on = np.zeros(windows, bool)
        goes_on[1:] = inside[1:] & inside[:-1] & (at[1:] == at[:-1])
        a, b = _runs(inside, goes_on)
        out = np.zeros(len(a), ENTRY)
        out["seed"], out["start"], out["size"] = named[a], a, b - a + length
        many = np.zeros(len(a), bool)
        if len(frequent):
            many = frequent[np.minimum(np.searchsorted(frequent, out["seed"]), len(frequent) - 1)] == out["seed"]
        if many.any():  # each window for itself
            count = (b - a + 1)[many]
            p = np.repeat(a[many], count) + np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
            single = np.zeros(len(p), ENTRY)
            single["start"], single["size"] = p, length
            single["seed"] = w.mix((sums[p + length] - sums[p]) * back[p] + np.uint64(77))
            out = np.concatenate([out[~many], single])
        p, size = out["start"].astype(np.int64), out["size"].astype(np.int64)
        out["hash"] = w.mix((sums[p + size] - sums[p]) * back[p] + size.astype(np.uint64))
    return out, text[out["start"]]


def pieces(column: pa.Array, length: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(bytes, offsets, row of each text, its place in that row) of about SLICE bytes; windows of a longer text are dealt to several."""
    for data, offsets, row in w.slices(column):
        if len(offsets) > 2 or len(data) <= w.SLICE:
            yield data, offsets, np.arange(row, row + len(offsets) - 1), np.zeros(len(offsets) - 1, np.int64)
            continue
        for p in range(0, max(1, len(data) - length + 1), w.SLICE):
            part = data[p : p + w.SLICE + length - 1]
            yield part, np.array([0, len(part)]), np.array([row]), np.array([p])


def entries(batch: pa.RecordBatch, length: int, seed: int, frequent: np.ndarray) -> Iterator[tuple[np.ndarray, int]]:
    """(entries, bytes that they are of) of a batch of (doc_id, text), a slice at a time."""
    ids = batch["doc_id"].to_numpy(zero_copy_only=False)
    for data, offsets, rows, at in pieces(batch["text"], length):
        found, text = stretches(data, offsets, length, seed, frequent)
        found["doc"] = ids[rows][text]
        found["start"] += (at - offsets[:-1])[text].astype(np.int32)
        yield found, len(data)


def folded(e: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(the first of equal stretches, the later ones)."""
    order = np.argsort(e["seed"], kind="stable")
    seed = e["seed"][order]
    same = seed[1:] == seed[:-1]
    shared = np.append(same, False) | np.append(False, same)
    alone, e = e[order[~shared]], e[order[shared]]
    e = e[np.lexsort((e["start"], e["doc"], e["size"], e["hash"], e["seed"]))]
    later = np.zeros(len(e), bool)
    later[1:] = (e["seed"][1:] == e["seed"][:-1]) & (e["hash"][1:] == e["hash"][:-1]) & (e["size"][1:] == e["size"][:-1])
    return np.concatenate([alone, e[~later]]), e[later]


def merged(doc: np.ndarray, start: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(doc, start, size) of the spans that the given ones make together, where they touch."""
    order = np.lexsort((start, doc))
    doc, start, end = doc[order], start[order].astype(np.int64), (start[order].astype(np.int64) + size[order])
    if not len(doc):
        return doc, start, end
    number = np.cumsum(np.append(True, doc[1:] != doc[:-1]))
    # the furthest end so far within a document: documents are set apart by more than any end
    apart = number * (int(end.max()) + 1)
    reach = np.maximum.accumulate(end + apart) - apart
    new = np.append(True, (doc[1:] != doc[:-1]) | (start[1:] > reach[:-1]))
    last = np.append(np.flatnonzero(new)[1:], len(doc)) - 1
    return doc[new], start[new], reach[last] - start[new]


def _found(doc: np.ndarray, start: np.ndarray, size: np.ndarray, seed: np.ndarray | None = None) -> Iterator[pa.RecordBatch]:
    span = pa.array((start.astype(np.int64) << 32) | size.astype(np.int64))
    told = pa.nulls(len(doc), pa.int64()) if seed is None else pa.array(seed.view(np.int64))
    whole = pa.RecordBatch.from_arrays([pa.array(doc), span, told], names=["doc_id", "span", "seed"])
    for i in range(0, len(doc), 100_000):
        yield whole.slice(i, 100_000)


def _sampled(length: int, seed: int):
    """(seed, n) of sampled documents' stretches; a null seed counts bytes of all texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = 0
        for batch in batches:
            total += sum(len(data) for data, _, _ in w.slices(batch["text"]))
            ids = batch["doc_id"].to_numpy(zero_copy_only=False)
            with np.errstate(over="ignore"):
                some = w.mix(ids.astype(np.int64).view(np.uint64)) % np.uint64(SAMPLED) == 0
            for found, _ in entries(batch.filter(pa.array(some)), length, seed, np.zeros(0, np.uint64)):
                seeds, n = np.unique(found["seed"], return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(seeds.view(np.int64)), pa.array(n)], names=["seed", "n"])
        yield pa.RecordBatch.from_arrays([pa.nulls(1, pa.int64()), pa.array([total], pa.int64())], names=["seed", "n"])

    return run


def _packed(length: int, seed: int, buckets: int, sent):
    """Stretches of many texts, folded among themselves and packed by the bucket of their seed."""

    def pack(held: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        first, later = folded(np.concatenate(held))
        bucket = (first["seed"] % np.uint64(buckets)).astype(np.int32)
        order = np.argsort(bucket, kind="stable")
        first, bucket = first[order], bucket[order]
        cuts = np.append(np.flatnonzero(np.append(True, bucket[1:] != bucket[:-1])), len(first)) if len(first) else np.zeros(1, int)
        rows = [(int(bucket[a]), False, _columns(first[a:b])) for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True)]
        if len(later):  # settled: to any bucket
            doc, start, size = merged(later["doc"], later["start"], later["size"])
            own = np.zeros(len(doc), ENTRY)
            own["doc"], own["start"], own["size"] = doc, start, size
            rows.append((int(later["seed"][0] % np.uint64(buckets)), True, _columns(own)))
        if rows:
            kinds = (pa.int32(), pa.bool_(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=["bucket", "settled", "body"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            for found, n in entries(batch, length, seed, sent.value):
                held.append(found)
                size += n
                if size >= PACK:
                    yield from pack(held)
                    held, size = [], 0
        if held:
            yield from pack(held)

    return run


def _columns(e: np.ndarray) -> bytes:
    """Column by column, which packs better than entry by entry."""
    return b"".join(np.ascontiguousarray(e[c]).tobytes() for c in ENTRY.names)


def _entries(body: bytes) -> np.ndarray:
    n, at = len(body) // ENTRY.itemsize, 0
    out = np.zeros(n, ENTRY)
    for c in ENTRY.names:
        out[c] = np.frombuffer(body, ENTRY[c], n, at)
        at += n * ENTRY[c].itemsize
    return out


def _settled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Spans: of repeated stretches without a seed, of those to be compared byte by byte with theirs."""
    held = []
    for batch in batches:
        for done, body in zip(batch["settled"].to_pylist(), batch["body"], strict=True):
            e = _entries(body.as_buffer())
            if done:
                yield from _found(e["doc"], e["start"], e["size"])
            else:
                held.append(e)
    if held:
        first, later = folded(np.concatenate(held))
        held.clear()
        yield from _found(later["doc"], later["start"], later["size"])
        order = np.argsort(first["seed"], kind="stable")
        seed = first["seed"][order]
        same = seed[1:] == seed[:-1]
        e = first[order[np.append(same, False) | np.append(False, same)]]
        yield from _found(e["doc"], e["start"], e["size"], np.ascontiguousarray(e["seed"]))


def _spans_of(spans: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return spans >> 32, spans & 0xFFFFFFFF


def _fetched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(seed, doc_id, start, piece) from each text and its asked spans."""
    for batch in batches:
        data, offsets = w.text_buffers(batch["text"])
        asked = batch["asked"]
        spans, seeds = (asked.flatten().field(c).to_numpy() for c in ("span", "seed"))
        n = pa.compute.list_value_length(asked).to_numpy(zero_copy_only=False)
        row = np.repeat(np.arange(len(n)), n)
        start, size = _spans_of(spans)
        begin = offsets[row] + start
        ids = batch["doc_id"].to_numpy()[row]
        for i in range(0, len(row), 10_000):
            part = slice(i, i + 10_000)
            raw = [data[a : a + s].tobytes() for a, s in zip(begin[part].tolist(), size[part].tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays(
                [pa.array(seeds[part]), pa.array(ids[part]), pa.array(start[part]), pa.array(raw, pa.binary())], names=["seed", "doc_id", "start", "piece"]
            )


def suffix_order(text: np.ndarray, length: int) -> np.ndarray:
    """Suffixes by their first ``length`` symbols (under 512), by prefix doubling; past its end the text is lowest."""
    n, held = len(text), 7
    long = np.append(text.astype(np.int64), np.zeros(held, np.int64))
    key = np.zeros(n, np.int64)
    for j in range(held):
        key = key << 9 | long[j : j + n]
    while True:
        order = np.argsort(key, kind="stable")
        ranked = key[order]
        new = np.append(True, ranked[1:] != ranked[:-1])
        rank = np.zeros(n + length, np.int64)
        rank[order] = np.cumsum(new)
        if held >= length or new.all():
            return order
        step = min(held, length - held)
        key = rank[:n] * (n + 1) + rank[step : step + n]
        held += step


def short_ends(text: np.ndarray, order: np.ndarray, length: int) -> np.ndarray:
    """For each place of the suffix array whether fewer than ``length`` symbols are shared with the suffix before.

    ``text`` ends with a symbol that is lowest and met nowhere else. Intervals of suffixes that begin with the same
    string grow by one symbol in front a round; one whose right end is new is kept, others end there.
    """
    n = len(text)
    bwt = text[order - 1]
    by_symbol = np.argsort(bwt, kind="stable")
    ahead = np.empty(n, np.int64)  # where the suffix one symbol longer lies
    ahead[by_symbol] = np.arange(n)
    same = np.append(False, bwt[by_symbol][1:] == bwt[by_symbol][:-1])
    before, after = np.full(n, -1), np.full(n, n)  # nearest places with the same symbol
    before[by_symbol[same]] = by_symbol[np.flatnonzero(same) - 1]
    after[by_symbol[np.flatnonzero(same) - 1]] = by_symbol[same]
    change = np.append(np.flatnonzero(bwt[1:] != bwt[:-1]), n - 1)
    run_end = change[np.searchsorted(change, np.arange(n))]
    short = np.zeros(n + 1, bool)
    short[[0, n]] = True
    low, high = np.array([0]), np.array([n - 1])
    for _ in range(length):
        alike = run_end[low] >= high  # one symbol before all of them
        a, b = ahead[low[alike]], ahead[high[alike]]
        low, high = low[~alike], high[~alike]
        if len(low):
            size = high - low + 1
            place = np.repeat(low - np.cumsum(size) + size, size) + np.arange(size.sum())
            firsts = place[before[place] < np.repeat(low, size)]
            lasts = place[after[place] > np.repeat(high, size)]
            # intervals don't overlap: their ends pair up in order
            a, b = np.append(a, np.sort(ahead[firsts])), np.append(b, np.sort(ahead[lasts]))
        new = ~short[b + 1]
        short[b[new] + 1] = True
        low, high = a[new], b[new]
    return short[:n]


def repeated_windows(pieces: list[bytes], doc: np.ndarray, start: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """(doc, start) of the windows of the pieces, each at its document and place, that also begin earlier."""
    sizes = np.array([len(p) for p in pieces])
    begin = np.cumsum(sizes + 1) - sizes - 1
    text = np.ones(int(sizes.sum()) + len(pieces) + 1, np.uint16)  # 1 ends a piece, 0 the text
    text[-1] = 0
    row = np.repeat(np.arange(len(pieces)), sizes)
    inside = np.arange(len(row)) + row
    text[inside] = np.frombuffer(b"".join(pieces), np.uint8).astype(np.uint16) + 2
    order = suffix_order(text, length)
    of = np.empty(len(text), np.int64)
    of[order] = np.cumsum(short_ends(text, order, length))
    at = inside - begin[row]
    whole = at <= sizes[row] - length
    row, at, of = row[whole], at[whole], of[inside[whole]]
    doc, at = doc[row], start[row] + at
    by = np.lexsort((at, doc, of))
    later = np.append(False, of[by][1:] == of[by][:-1])
    return doc[by][later], at[by][later]


def _compared(length: int):
    def compare(held: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = pa.Table.from_batches(held)
        doc, at = repeated_windows(t["piece"].to_pylist(), t["doc_id"].to_numpy(), t["start"].to_numpy(), length)
        yield from _found(*merged(doc, at, np.full(len(at), length)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size, last = [], 0, None
        for batch in batches:
            if not batch.num_rows:
                continue
            seeds = batch["seed"].to_numpy()
            ends = np.append(np.flatnonzero(seeds[1:] != seeds[:-1]) + 1, len(seeds)).tolist()
            sums = np.cumsum(pa.compute.binary_length(batch["piece"]).to_numpy()).tolist()
            from_row = from_byte = 0
            if held and seeds[0] != last and size >= INDEX:
                yield from compare(held)
                held, size = [], 0
            for end in ends[:-1]:  # a block ends where a seed does
                if size + sums[end - 1] - from_byte >= INDEX:
                    yield from compare([*held, batch.slice(from_row, end - from_row)])
                    held, size, from_row, from_byte = [], 0, end, sums[end - 1]
            if from_row < len(seeds):
                held.append(batch.slice(from_row))
                size += sums[-1] - from_byte
            last = seeds[-1]
        if held:
            yield from compare(held)

    return run


def _forget(spark: SparkSession) -> None:
    """Let Spark drop the shuffles of plans that are done with, before the next ones need the disk."""
    gc.collect()
    spark._jvm.System.gc()


def _numbered(docs: DataFrame) -> tuple[DataFrame, DataFrame | None]:
    """(docs, numbers): where ids repeat, documents numbered in the order of (doc_id, digest); else as they are."""
    repeat = docs.groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1").limit(1).count()
    if not repeat:
        return docs, None
    docs = docs.withColumn("digest", F.sha2(F.encode("text", "utf-8"), 256))
    ordered = docs.select("doc_id", "digest").distinct().orderBy("doc_id", "digest")
    numbers = materialize(ordered.withColumn("number", F.monotonically_increasing_id()), "numbers")  # rises with the order
    docs = docs.dropDuplicates(["doc_id", "digest"]).join(numbers, ["doc_id", "digest"])
    return materialize(docs.select(F.col("number").alias("doc_id"), "text"), "numbered"), numbers


def repeated_spans(docs: DataFrame, length: int = LENGTH, seed: int = SEED) -> DataFrame:
    """(doc_id, span) of what is repeated, in bytes: start << 32 | size; spans may overlap. ``docs``: doc_id, text; ids are unique."""
    spark = docs.sparkSession
    schema = "seed bigint, n bigint"
    sample = materialize(docs.mapInArrow(w.lean(_sampled(length, seed)), schema).groupBy("seed").agg(F.sum("n").alias("n")), "seeds")
    size = sample.where("seed is null").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    least = max(FREQUENT, 2 * size // ((length - seed + 2) * SHARE)) / SAMPLED
    frequent = [r[0] for r in sample.where(F.col("seed").isNotNull() & (F.col("n") >= least)).select("seed").toLocalIterator()]
    sent = spark.sparkContext.broadcast(np.sort(np.array(frequent, np.int64).view(np.uint64)))
    buckets = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size * ENTRY.itemsize * 2 // ((length - seed + 2) * FOLD)))
    packed = docs.mapInArrow(w.lean(_packed(length, seed, buckets, sent)), PACKED)
    told = materialize(packed.repartition(buckets, "bucket").select("settled", "body").mapInArrow(w.lean(_settled), FOUND), "told")
    discard(sample)
    del packed, sample
    _forget(spark)
    asked = told.where("seed is not null")
    size = asked.agg(F.coalesce(F.sum(F.col("span").bitwiseAND(0xFFFFFFFF)), F.lit(0))).first()[0]
    settled = told.where("seed is null").select("doc_id", "span")
    if not size:
        return settled
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size // (4 * INDEX)))
    by_doc = asked.groupBy("doc_id").agg(F.collect_list(F.struct("span", "seed")).alias("asked"))
    fetched = docs.join(by_doc, "doc_id").select("doc_id", "text", "asked").mapInArrow(w.lean(_fetched), "seed bigint, doc_id bigint, start bigint, piece binary")
    compared = fetched.repartition(parts, "seed").sortWithinPartitions("seed").mapInArrow(w.lean(_compared(length)), FOUND)
    found = materialize(compared.select("doc_id", "span"), "compared")
    del by_doc, fetched, compared
    _forget(spark)
    return settled.unionByName(found)


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each text without its spans."""
    for batch in batches:
        data, offsets = w.text_buffers(batch["text"])
        lists = batch["spans"].to_pylist()
        rows, size = [], 0
        for i, (a, b) in enumerate(zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)):
            own = np.array(lists[i] or [], np.int64)
            start, n = _spans_of(own)
            _, start, n = merged(np.zeros(len(own), np.int64), start, n)
            ends = [0, *(start + n).tolist()]
            kept = b"".join(data[a + s : a + e].tobytes() for s, e in zip(ends, [*start.tolist(), b - a], strict=True))
            rows.append((b - a, int(n.sum()), len(n), [{"start": s, "size": m} for s, m in zip(start.tolist(), n.tolist(), strict=True)], kept))
            size += len(kept)
            if size > 4 << 20 or i + 1 == batch.num_rows:
                yield _cut_batch(batch["doc_id"].slice(i + 1 - len(rows), len(rows)), rows)
                rows, size = [], 0


def _cut_batch(ids: pa.Array, rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.struct([("start", pa.int64()), ("size", pa.int64())])), pa.binary())
    columns = [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)]
    return pa.RecordBatch.from_arrays([ids, *columns], names=["doc_id", "n_bytes", "n_removed", "n_spans", "spans", "kept"])


def without_repeats(docs: DataFrame, length: int = LENGTH, seed: int = SEED) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, spans, kept) of every row of ``docs`` (doc_id, text); kept: the bytes that stay."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    named = rows.where("doc_id is not null")
    plain, numbers = _numbered(named)
    spans = repeated_spans(plain, length, seed).groupBy("doc_id").agg(F.collect_list("span").alias("spans"))
    schema = "doc_id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, spans array<struct<start:bigint,size:bigint>>, kept binary"
    if numbers is not None:
        spans = numbers.join(spans.withColumnRenamed("doc_id", "number"), "number").select("doc_id", "digest", "spans")
        cut = named.withColumn("digest", F.sha2(F.encode("text", "utf-8"), 256)).join(spans, ["doc_id", "digest"], "left")
    else:
        cut = named.join(spans, "doc_id", "left")
    nameless = rows.where("doc_id is null").select("doc_id", "text", F.lit(None).cast("array<bigint>").alias("spans"))
    return cut.select("doc_id", "text", "spans").unionByName(nameless).mapInArrow(w.lean(_cut), schema)


def op12_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = without_repeats(table(spark, sf_dir, "documents"))
    return cut.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


SQL = """
WITH d AS (
  SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents
), p AS (
  SELECT doc_id, md5_number(substr(h, 2 * s + 1, 200)) AS w, s FROM (SELECT doc_id, h, unnest(range(0, CAST(length(h) / 2 AS BIGINT) - 99)) AS s FROM d)
), r AS (
  SELECT doc_id, s FROM p QUALIFY row_number() OVER (PARTITION BY w ORDER BY doc_id, s) > 1
), g AS (
  SELECT doc_id, s, sum(fresh) OVER (PARTITION BY doc_id ORDER BY s) AS span
  FROM (SELECT doc_id, s, CASE WHEN s <= lag(s) OVER (PARTITION BY doc_id ORDER BY s) + 100 THEN 0 ELSE 1 END AS fresh FROM r)
), i AS (
  SELECT doc_id, min(s) AS a, max(s) + 100 AS b FROM g GROUP BY doc_id, span
), k AS (
  SELECT doc_id, b, a, lead(a) OVER (PARTITION BY doc_id ORDER BY a) AS upto, row_number() OVER (PARTITION BY doc_id ORDER BY a) AS n FROM i
), c AS (
  SELECT d.doc_id, CAST(length(h) / 2 AS BIGINT) AS n_bytes, CAST(coalesce(sum(b - a), 0) AS BIGINT) AS n_removed, count(a) AS n_spans,
    CASE WHEN count(a) = 0 THEN h ELSE
      substr(h, 1, 2 * min(a)) || string_agg(substr(h, 2 * b + 1, 2 * (coalesce(upto, CAST(length(h) / 2 AS BIGINT)) - b)), '' ORDER BY a) END AS kept
  FROM d LEFT JOIN k USING (doc_id) GROUP BY d.doc_id, h
)
SELECT doc_id, n_bytes, n_removed, n_spans, sha256(unhex(kept)) AS kept_sha256 FROM c
"""
