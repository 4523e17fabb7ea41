"""Substring dedup by paragraph MinHash banding.

Passages are compared at two cuts of each text. Its paragraphs (lines) of LEAST words or more carry MinHash
signatures of their 5-word shingles, in bands tuned for recall: 8 bands of 3 find a pair at Jaccard 0.8 with a
chance of 99.7 %. Repeated passages need not begin where a paragraph does, so windows of WINDOW words are
cut as well, at places that the words themselves choose (winnowing): every passage of WINDOW + GAP - 1 = 51
words or more holds a window that is cut alike wherever the passage stands.

Equal paragraphs fold into one class. Within a band's bucket all pairs of classes are compared by the exact
Jaccard of their shingle sets, until the bucket is one component; buckets too large for a task are cut into
blocks, and each pair of blocks is one task. Buckets of equal members are compared once. Verified paragraphs
form connected components; the first of each, by (doc_id, position), stays and the others are removed.

Windows follow, of what paragraphs left: a window's copies are removed in favour of the first place, by
(doc_id, position), that touches no removed paragraph. Hits of one document and diagonal form chains, which are
compared word by word with the text of that place, MARGIN words beyond either end, but not with paragraphs removed
there; only such stretches of the sources are shipped. Every run of WINDOW equal words or more is taken. A copy always stands after
its source, so where a source is itself removed, what was taken from it is traced to where that stays. Rows of
one document may overlap, as far as different copies stay; a row contained in another one is left out.

Only passages that stand in two documents at least are taken, and none is taken from the first document that holds
it: what a text repeats within itself stays where no earlier document has it. A removed paragraph that is alike but not equal to
the one that stays names its document, also where a repeated passage is later cut from that one. Defined results: null and empty texts have no
passages; equal rows share a doc_id and count as one document; rows with a null doc_id take no part.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from galley.llm.common import connected_components, discard, materialize
from galley.llm.op5_hyperminhash import links_within
from galley.llm.words import Words, groups, lean, mix, words
from galley.tables import table

SHINGLE = 5
LEAST = 25  # words of a paragraph
WINDOW, GAP = 24, 28
BANDS, ROWS = 8, 3
NUM, DEN = 4, 5  # the least Jaccard
#: Hits at most CHAIN words apart are grown together, and compared MARGIN words beyond. Anchors of a match stand GAP
#: words apart at most, so MARGIN only has to exceed that.
CHAIN, MARGIN = 256, 64
#: Paragraphs and words that one task compares.
BLOCK_ROWS, BLOCK_WORDS = 1024, 1 << 20
_TOP = np.uint64(2**64 - 1)
_SEEDS = mix(np.arange(1, BANDS * ROWS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def _sliding(x: np.ndarray, n: int, f) -> np.ndarray:
    """f over each n consecutive values, from each position on; the last n - 1 positions are not to be used."""
    out, width = x.copy(), 1
    while width * 2 <= n:
        out[: len(out) - width] = f(out[: len(out) - width], out[width:])
        width *= 2
    if n > width:
        out[: len(out) - (n - width)] = f(out[: len(out) - (n - width)], out[n - width :])
    return out


def anchors(w: Words) -> tuple[np.ndarray, np.ndarray]:
    """(word positions, hashes) of the winnowed windows of all texts."""
    h, ok = w.shingles(WINDOW)
    n = len(h)
    if n < WINDOW:
        return np.zeros(0, np.int64), h[:0]
    left = np.repeat(w.first[1:], np.diff(w.first)) - np.arange(n)
    inside = left >= WINDOW + GAP - 1  # GAP windows fit from here on
    low = np.where(inside, _sliding(np.where(ok, h, _TOP), GAP, np.minimum), np.uint64(0))
    # a window is cut where it is the smallest of some GAP neighbours: the largest of the minima that it takes part in
    back = _sliding(np.concatenate([np.zeros(GAP - 1, np.uint64), low]), GAP, np.maximum)[:n]
    take = ok & (h == back)
    for a, b in zip(w.first[:-1].tolist(), w.first[1:].tolist(), strict=True):
        if WINDOW <= b - a < WINDOW + GAP - 1:
            take[a + int(np.argmin(h[a : b - WINDOW + 1]))] = True
    at = np.flatnonzero(take)
    return at, h[at]


def paragraphs(w: Words) -> tuple[np.ndarray, np.ndarray]:
    """(first word, words) of the paragraphs of all texts; a line feed or a text's end closes one."""
    n = len(w.hashes)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    line = np.searchsorted(np.flatnonzero(w.data == 10), w.start)
    cut = np.zeros(n, bool)
    cut[0] = True
    cut[1:] = line[1:] != line[:-1]
    cut[w.first[:-1][w.first[:-1] < n]] = True
    start = np.flatnonzero(cut)
    return start, np.diff(np.append(start, n))


PASSAGES = "key bigint, doc_id bigint, start int, words int, exact bigint, bands array<bigint>"


def _passages(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Windows with their key (exact 0, no bands), and paragraphs with the hash of their words and their band keys."""
    for batch in batches:
        ids = batch["doc_id"].to_numpy(zero_copy_only=False)
        for w in words(batch["text"]):
            with np.errstate(over="ignore"):
                at, key = anchors(w)
                start, size = paragraphs(w)
                long = size >= LEAST
                s, z = start[long], size[long]
                exact, bands = np.zeros(0, np.int64), np.zeros((0, BANDS), np.uint64)
                if long.any():
                    sh, _ = w.shingles(SHINGLE)
                    place = np.arange(len(sh)) - np.repeat(start, size)
                    inside = np.repeat(long, size) & (place + SHINGLE <= np.repeat(size, size))
                    kept, first = sh[inside], np.append(0, np.cumsum(z - SHINGLE + 1))[:-1]
                    exact = np.add.reduceat(mix(w.hashes + place.astype(np.uint64)), start)[long].view(np.int64)
                    exact = np.where(exact == 0, 1, exact)
                    bands = np.empty((len(s), BANDS), np.uint64)
                    for band in range(BANDS):
                        keys = np.full(len(s), np.uint64(band + 1))
                        for seed in _SEEDS[band * ROWS : (band + 1) * ROWS]:
                            v = kept * (seed | np.uint64(1))  # shingles are mixed already; the high bits decide
                            keys = mix(keys * np.uint64(31) + np.minimum.reduceat(v, first))
                        bands[:, band] = keys
            position = np.concatenate([at, s])
            text = np.searchsorted(w.first, position, "right") - 1
            none, some = np.zeros(len(at), np.int64), np.zeros(len(s), np.int64)
            cuts = np.concatenate([none, np.arange(len(s) + 1) * BANDS]).astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.concatenate([key.view(np.int64), some])),
                    pa.array(ids[w.row + text].astype(np.int64)),
                    pa.array((position - w.first[text]).astype(np.int32)),
                    pa.array(np.concatenate([none + WINDOW, z]).astype(np.int32)),
                    pa.array(np.concatenate([none, exact])),
                    pa.ListArray.from_arrays(pa.array(cuts), pa.array(bands.ravel().view(np.int64))),
                ],
                names=["key", "doc_id", "start", "words", "exact", "bands"],
            )


def _shingle_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Shingle sets of the listed paragraphs (start, words, exact) of each text."""
    for batch in batches:
        wanted = batch["wanted"].to_pylist()
        for w in words(batch["text"]):
            with np.errstate(over="ignore"):
                sh, _ = w.shingles(SHINGLE)
            e, v = [], []
            for i in range(len(w)):
                for x in wanted[w.row + i]:
                    a = w.first[i] + x["start"]
                    e.append(x["exact"])
                    v.append(np.unique(sh[a : a + x["words"] - SHINGLE + 1]))
            cuts = np.append(0, np.cumsum([len(x) for x in v])).astype(np.int32)
            flat = np.concatenate([np.zeros(0, np.uint64), *v]).view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(e, pa.int64()), pa.ListArray.from_arrays(pa.array(cuts), pa.array(flat))], names=["exact", "shingles"])


def _linked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Spanning links (a, b) of each (key, part)'s paragraphs, all pairs considered."""
    for group in groups(batches, ["key", "part"]):
        exact, sets = group["exact"].to_numpy(), group["shingles"].combine_chunks()
        if isinstance(sets, pa.ChunkedArray):
            sets = pa.concat_arrays(sets.chunks)
        cuts, flat = sets.offsets.to_numpy(), sets.values.to_numpy()
        order = np.argsort(exact)
        pairs = links_within([flat[cuts[i] : cuts[i + 1]] for i in order.tolist()], NUM, DEN)
        a, b = (np.array([exact[order[p[x]]] for p in pairs], np.int64) for x in (0, 1))
        yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])


def _paragraph_links(texts: DataFrame, paras: DataFrame) -> DataFrame:
    """(a, b): spanning links of the paragraph classes (exact) that share a band and are alike."""
    keys = paras.select("exact", "words", "bands").distinct().select("exact", "words", F.explode("bands").alias("key"))
    mixed = keys.groupBy("key").agg(F.min("exact").alias("least"), F.max("exact").alias("most")).where("least < most").select("key")
    members = materialize(keys.distinct().join(mixed, "key"), "members")
    # buckets of the same members, as the bands of close copies are, count as one
    sized = members.groupBy("key").agg(
        F.count("*").alias("n"), F.sum(F.col("words").cast("long")).alias("words"),
        F.bit_xor(F.xxhash64("exact")).alias("x"), F.bit_xor(F.xxhash64("exact", F.lit(1))).alias("y"),
    )
    blocks = F.greatest(F.ceil(F.col("n") / BLOCK_ROWS), F.ceil(F.col("words") / BLOCK_WORDS)).cast("int")
    once = sized.groupBy("n", "words", "x", "y").agg(F.min("key").alias("key")).select("key", blocks.alias("blocks"))
    mine = members.join(once, "key").withColumn("block", F.pmod(F.xxhash64("exact"), F.col("blocks")).cast("int"))
    # one part for each pair of blocks: numbered low * blocks + high
    parts = mine.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).where((F.col("blocks") == 1) | (F.col("other") != F.col("block")))
    parts = parts.select("exact", "key", (F.least("block", "other").cast("long") * F.col("blocks") + F.greatest("block", "other")).alias("part"))
    one = paras.join(members.select("exact").distinct(), "exact", "left_semi").groupBy("exact").agg(F.min(F.struct("doc_id", "start", "words")).alias("at"))
    wanted = one.groupBy("at.doc_id").agg(F.collect_list(F.struct("at.start", "at.words", "exact")).alias("wanted"))
    sets = texts.join(wanted.select("doc_id"), "doc_id", "left_semi").dropDuplicates(["doc_id"]).join(wanted, "doc_id")
    sets = materialize(sets.mapInArrow(lean(_shingle_sets), "exact bigint, shingles array<bigint>"), "shingles")
    grouped = parts.join(sets, "exact").select("key", "part", "exact", "shingles").repartition("key", "part").sortWithinPartitions("key", "part")
    links = materialize(grouped.mapInArrow(lean(_linked), "a bigint, b bigint"), "links")
    discard(members, sets)
    return links


def _repeated_paragraphs(texts: DataFrame, paras: DataFrame) -> DataFrame:
    """(doc_id, start, words, exact, first): the paragraphs of components in two documents or more, but the first of each."""
    comps = connected_components(_paragraph_links(texts, paras)).select(F.col("node").alias("exact"), "component")
    placed = paras.select("doc_id", "start", "words", "exact").join(comps, "exact", "left").withColumn("component", F.coalesce("component", "exact"))
    first = placed.groupBy("component").agg(F.min(F.struct("doc_id", "start", "exact")).alias("first"), F.max("doc_id").alias("most"))
    lines = placed.join(first.where(F.col("most") > F.col("first.doc_id")), "component").where(F.col("doc_id") != F.col("first.doc_id"))
    return lines.select("doc_id", "start", "words", "exact", "first").distinct()


PIECE = "doc_id bigint, start int, n int, to_id bigint, to_start int"
SOURCE = "to_id bigint, low int, high int, source binary"


def _sources(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Word hashes of the asked stretches (low, high) of each text; words of removed paragraphs are 0."""
    for batch in batches:
        ids, asked, gone = batch["to_id"].to_pylist(), batch["asked"].to_pylist(), batch["gone"].to_pylist()
        for w in words(batch["text"]):
            out = []
            for k in range(len(w)):
                own = w.hashes[w.first[k] : w.first[k + 1]].copy()
                for g in gone[w.row + k] or []:
                    own[g["start"] : g["end"]] = 0
                out += [(ids[w.row + k], x["low"], x["high"], own[x["low"] : x["high"]].tobytes()) for x in asked[w.row + k]]
            to, low, high, source = zip(*out, strict=True) if out else ((), (), (), ())
            yield pa.RecordBatch.from_arrays([pa.array(to, pa.int64()), pa.array(low, pa.int32()), pa.array(high, pa.int32()), pa.array(source, pa.binary())], names=["to_id", "low", "high", "source"])


def _pieces(a: np.ndarray, b: np.ndarray, at: int) -> list[tuple[int, int]]:
    """(start, words) of the runs of WINDOW words or more of ``a`` that ``b``, laid at ``at``, has as well."""
    low, high = max(0, at), min(len(a), at + len(b))
    if high - low < WINDOW:
        return []
    same = np.concatenate([[False], a[low:high] == b[low - at : high - at], [False]])
    edge = np.flatnonzero(same[1:] != same[:-1])
    return [(low + x, y - x) for x, y in zip(edge[::2].tolist(), edge[1::2].tolist(), strict=True) if y - x >= WINDOW]


def _grown(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids, chains = batch["doc_id"].to_pylist(), batch["chains"]
        for w in words(batch["text"]):
            out = []
            for k in range(len(w)):
                a = w.hashes[w.first[k] : w.first[k + 1]]
                for x in chains[w.row + k].as_py():
                    at = x["low"] + x["ahead"]
                    out += [(ids[w.row + k], start, n, x["to_id"], start - x["ahead"]) for start, n in _pieces(a, np.frombuffer(x["source"], np.uint64), at)]
            yield pa.RecordBatch.from_arrays([pa.array([x[c] for x in out], f.type) for c, f in enumerate(_PIECE)], schema=_PIECE)


_PIECE = pa.schema([("doc_id", pa.int64()), ("start", pa.int32()), ("n", pa.int32()), ("to_id", pa.int64()), ("to_start", pa.int32())])


def _traced(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pieces whose source is partly removed: what stays of it, and the rest with the source's own source."""
    for batch in batches:
        out = []
        for x in batch.to_pylist():
            low, high, at = x["to_start"], x["to_start"] + x["n"], x["to_start"]
            place = lambda a, b, to, to_start: {"doc_id": x["doc_id"], "start": x["start"] + a - low, "n": b - a, "to_id": to, "to_start": to_start}  # noqa: B023, E731
            for g in sorted(x["cut"], key=lambda g: g["start"]):
                a, b = max(low, g["start"]), min(high, g["start"] + g["n"])
                if a >= b:
                    continue
                if a > at:
                    out.append(place(at, a, x["to_id"], at))
                out.append(place(a, b, g["to_id"], g["to_start"] + a - g["start"]))
                at = max(at, b)
            if at < high:
                out.append(place(at, high, x["to_id"], at))
        yield pa.RecordBatch.from_pylist(out, schema=_PIECE)


def _uncontained(pieces: DataFrame, *more: str) -> DataFrame:
    """``pieces`` without those that lie within another one of their document."""
    end = F.col("start") + F.col("n")
    before = Window.partitionBy("doc_id").orderBy("start", F.col("n").desc(), "to_id", *more).rowsBetween(Window.unboundedPreceding, -1)
    return pieces.withColumn("upto", F.coalesce(F.max(end).over(before), F.lit(-1))).where(end > F.col("upto")).drop("upto")


def _window_hits(wins: DataFrame, gone: DataFrame) -> DataFrame:
    """(doc_id, start, to_id, to_start): windows and the first place of each, of what removed paragraphs left."""
    two = wins.groupBy("key").agg(F.min("doc_id").alias("low"), F.max("doc_id").alias("high")).where("low < high").select("key")
    two = materialize(two, "two")  # tables of their own, so that Spark may split the rows of a hot key in the joins
    inside = lambda g: (g["start"] <= F.col("start")) & (g["end"] >= F.col("start") + WINDOW)
    touched = lambda g: (g["start"] < F.col("start") + WINDOW) & (g["end"] > F.col("start"))
    left = wins.join(two, "key").join(gone, "doc_id", "left").where(~F.coalesce(F.exists("gone", inside), F.lit(False)))
    left = materialize(left.select("key", "doc_id", "start", (~F.coalesce(F.exists("gone", touched), F.lit(False))).alias("whole")), "windows")
    lead = left.groupBy("key").agg(F.min(F.when(F.col("whole"), F.struct("doc_id", "start"))).alias("lead"), F.min("doc_id").alias("low"), F.max("doc_id").alias("high"))
    lead = materialize(lead.where("low < high and lead is not null").select("key", "lead"), "lead")
    return left.join(lead, "key").where(F.col("doc_id") > F.col("lead.doc_id")).select("doc_id", "start", F.col("lead.doc_id").alias("to_id"), F.col("lead.start").alias("to_start"))


def repeated_passages(docs: DataFrame) -> DataFrame:
    """(doc_id, start_word, n_words, kept_doc_id): the passages to remove, and whose copy stays.

    ``docs`` has doc_id and text. Words are counted from 0 in their text. Rows of a document may overlap.
    """
    texts = docs.where("doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    rows = materialize(texts.mapInArrow(lean(_passages), PASSAGES), "passages")
    lines = materialize(_repeated_paragraphs(texts, rows.where("exact <> 0").drop("key")), "lines")

    # removed paragraphs of each document, adjacent ones joined
    end = F.col("start") + F.col("words")
    order = Window.partitionBy("doc_id").orderBy("start", "words")
    new = (F.coalesce(F.max(end).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(-1)) < F.col("start")).cast("int")
    runs = lines.withColumn("new", new).withColumn("run", F.sum("new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    runs = runs.groupBy("doc_id", "run").agg(F.min("start").alias("start"), F.max(end).alias("end"))
    gone = materialize(runs.groupBy("doc_id").agg(F.collect_list(F.struct("start", "end")).alias("gone")), "gone")

    hits = _window_hits(rows.where("exact = 0").select("key", "doc_id", "start"), gone)
    # hits one behind the other, with as many words between in either text, are a chain
    hits = hits.select("doc_id", "start", "to_id", (F.col("start") - F.col("to_start")).alias("ahead")).distinct()
    along = Window.partitionBy("doc_id", "to_id", "ahead").orderBy("start")
    new = F.coalesce(F.col("start") - F.lag("start").over(along) > CHAIN, F.lit(True)).cast("int")
    hits = hits.withColumn("new", new).withColumn("chain", F.sum("new").over(along.rowsBetween(Window.unboundedPreceding, 0)))
    chains = hits.groupBy("doc_id", "to_id", "ahead", "chain").agg(F.min("start").alias("first"), F.max("start").alias("last"))
    low, high = F.greatest(F.lit(0), F.col("first") - F.col("ahead") - MARGIN), F.col("last") - F.col("ahead") + WINDOW + MARGIN
    chains = materialize(chains.select("doc_id", "to_id", "ahead", low.alias("low"), high.alias("high")), "chains")
    discard(rows)
    asked = chains.groupBy("to_id").agg(F.collect_set(F.struct("low", "high")).alias("asked"))
    one = lambda ids: texts.join(ids, "doc_id", "left_semi").dropDuplicates(["doc_id"])
    sources = one(asked.select(F.col("to_id").alias("doc_id"))).withColumnRenamed("doc_id", "to_id").join(asked, "to_id").join(gone.withColumnRenamed("doc_id", "to_id"), "to_id", "left")
    sources = materialize(sources.select("to_id", "text", "asked", "gone").mapInArrow(lean(_sources), SOURCE), "sources")
    mine = chains.join(sources, ["to_id", "low", "high"]).groupBy("doc_id").agg(F.collect_list(F.struct("to_id", "ahead", "low", "source")).alias("chains"))
    grown = one(chains.select("doc_id")).join(mine, "doc_id").select("doc_id", "text", "chains").mapInArrow(lean(_grown), PIECE)
    equal = lines.where("exact = first.exact").select("doc_id", "start", F.col("words").alias("n"), F.col("first.doc_id").alias("to_id"), F.col("first.start").alias("to_start"))
    pieces = materialize(_uncontained(grown.unionByName(equal).distinct(), "to_start"), "pieces")
    while True:
        # sources lie before their copies, so every piece comes to where its words stay
        cut = pieces.groupBy(F.col("doc_id").alias("to_id")).agg(F.collect_list(F.struct("start", "n", "to_id", "to_start")).alias("cut"))
        cut = materialize(cut, "cut")  # a table of its own, so that Spark may split the pieces of a hot source in the join
        lost = lambda g: (g["start"] < F.col("to_start") + F.col("n")) & (g["start"] + g["n"] > F.col("to_start"))
        marked = pieces.join(cut, "to_id", "left").withColumn("cut", F.coalesce(F.filter("cut", lost), F.array()))
        marked = materialize(marked, "marked")
        if marked.where(F.size("cut") > 0).isEmpty():
            break
        traced = marked.where(F.size("cut") > 0).select("doc_id", "start", "n", "to_id", "to_start", "cut").mapInArrow(lean(_traced), PIECE)
        traced = marked.where(F.size("cut") == 0).drop("cut").unionByName(traced).distinct()
        old, pieces = pieces, materialize(_uncontained(traced, "to_start"), "pieces")
        discard(old, marked, cut)
    discard(chains, sources, marked, cut)
    alike = lines.where("exact <> first.exact").select("doc_id", "start", F.col("words").alias("n"), F.col("first.doc_id").alias("to_id"))
    found = _uncontained(pieces.select("doc_id", "start", "n", "to_id").unionByName(alike))
    return found.select("doc_id", F.col("start").alias("start_word"), F.col("n").alias("n_words"), F.col("to_id").alias("kept_doc_id"))


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        runs, out = batch["__runs"].to_pylist(), []
        texts = batch["__text"].to_pylist()
        for w in words(batch["__text"]):
            for i in range(len(w)):
                row = w.row + i
                if not runs[row] or texts[row] is None:
                    out.append(texts[row])
                    continue
                data, at, parts = w.data[w.offsets[i] : w.offsets[i + 1]].tobytes(), 0, []
                for x in sorted(runs[row], key=lambda x: x["start_word"]):
                    # a row that repeats the id with a shorter text may end before the passage does
                    a, b = w.first[i] + x["start_word"], min(w.first[i] + x["start_word"] + x["n_words"], w.first[i + 1]) - 1
                    if a > b:
                        continue
                    parts.append(data[at : max(at, w.start[a] - w.offsets[i])])
                    at = max(at, int(w.end[b] - w.offsets[i]))
                out.append(b"".join([*parts, data[at:]]).decode())
        yield pa.RecordBatch.from_arrays([batch["__row"], pa.array(out, pa.string())], names=["__row", "text"])


def remove_passages(docs: DataFrame, runs: DataFrame) -> DataFrame:
    """``docs`` with the passages of repeated_passages() cut out of their texts; other texts are as they were.

    Passages are places in the text of a doc_id: rows that repeat an id lose the same words, as far as their text goes.
    """
    listed = runs.groupBy("doc_id").agg(F.collect_list(F.struct("start_word", "n_words")).alias("__runs"))
    named = docs.join(listed, "doc_id", "left")
    rest = [c for c in docs.columns if c != "text"]
    rows = named.select(F.struct(*[F.col(f"`{c}`") for c in rest]).alias("__row"), F.col("text").cast("string").alias("__text"), "__runs")
    from pyspark.sql import types as T

    schema = T.StructType([rows.schema["__row"], T.StructField("text", T.StringType())])
    return rows.mapInArrow(lean(_cut), schema).select(*[F.col(f"__row.`{c}`").alias(c) if c != "text" else F.col("text") for c in docs.columns])


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeated_passages(table(spark, sf_dir, "documents"))
