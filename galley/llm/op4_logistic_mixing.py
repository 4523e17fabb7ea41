"""Language-model scoring by logistic context mixing over bits.

Bytes are coded bit by bit. Six predictors look at hashed contexts, the last 0 to 5 bytes with the bits of
the current byte so far, and hold how often the next bit was 0 or 1 in the training texts. Their log odds
are mixed by weights that a gate selects: how well the two longest contexts are known. The mixture is refined
by a table of probabilities that moves with what was seen (adaptive probability map). Two sets of weights and
maps, for usual and for unusual text, are mixed online in each text: block after block, the set that coded
the last blocks better gains weight. Bits per byte, summed, give the log10 probability of a text.

How it is learned. From all training texts, at every size alike: every task sums its 6-byte grams, tokens and
chunks, sums are shuffled by key, and bit counts are derived from the grams, so the work follows the distinct
grams. Weights and maps are learned online, batch after batch, from all these grams in FOLD parts (ROUNDS times,
parts are merged after each), by occurrence for usual text, and each distinct gram once for unusual text. The
occurrence that is learned from is taken out of its counts first, else contexts would look better known than on new
texts. What is sent to the executors has fixed bounds: 2^SLOT_BITS slots of 4 bytes, and the HEAD most
frequent tokens.

Texts fall into chunks, which end where the hash of the last bytes says so. What grows with the corpus is the table
of all chunks of the training texts, which stays a Spark table and is joined: a chunk has the probability
known * (its share of all chunks) + (1 - known) * (what the bits give), where ``known`` is the share of occurrences
whose chunk occurs elsewhere too (Good and Turing). A training text's own chunks are taken out of the counts that
score it.

How it scores. Grams repeat, so a gram's cost is computed once per worker and kept (a table of fixed size;
what it loses is computed again).

The base is a unigram model over words with add-one smoothing. Counts of tokens beyond the HEAD are joined.

Defined results: a null text counts as empty; equal rows give equal rows; with no training texts all counts
are 0 and every bit costs 1. Very long texts are scored whole, by themselves.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from galley.llm.common import materialize
from galley.llm.words import mix, slices, words_of
from galley.tables import importable, table

ORDERS = 6
SLOT_BITS = 24
GATES = 12
HEAD = 200_000
BLOCK, MEMORY = 32, 4  # bytes of a block; blocks that decide the weight of the sets
CHUNK_BITS = 8  # a chunk has 2^CHUNK_BITS bytes on average
FOLD, ROUNDS, RATE = 250_000, 2, 0.3
END_TOKEN = np.uint64(0x5DEECE66D5DEECE6)
TOKEN, GRAM, CHUNK = 0, 1, 2
CACHE_BITS = 22
_TAKE_UP = 1_000_000  # distinct keys that a task sums before it passes them on
_TOGETHER = 150_000  # grams whose bits a task sums at once
_STEPS = np.linspace(-8, 8, 33)
_ODD, _ODDER = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)


def grams(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(ORDERS-byte grams, bounds): one for each byte of a text and for its end, a zero; zeros stand before it."""
    size = np.diff(offsets)
    bounds = np.append(0, np.cumsum(size + 1))
    before = ORDERS - 1
    text = np.zeros(bounds[-1] + before, np.uint64)
    place = np.arange(len(data)) + np.repeat(np.arange(len(size)), size)
    text[before + place] = data
    back = np.arange(bounds[-1]) - np.repeat(bounds[:-1], size + 1)  # bytes before, in this text
    out = text[before:].copy()
    for k in range(1, ORDERS):
        out |= np.where(back >= k, text[before - k : len(text) - k], np.uint64(0)) << np.uint64(8 * k)
    return out, bounds


def chunks(mixed: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(first bytes, keys) of the chunks of all texts, from the hashes of their grams."""
    last = (mixed & np.uint64((1 << CHUNK_BITS) - 1)) == 0
    last[bounds[1:] - 1] = True
    first = np.append(0, np.flatnonzero(last)[:-1] + 1)
    place = np.arange(len(mixed)) - np.repeat(first, np.diff(np.append(first, len(mixed))))
    return first, mix(np.add.reduceat(mixed * (place.astype(np.uint64) * np.uint64(2) + np.uint64(1)), first))


class Slots:
    """For each order the slots of the grams' contexts, with the first bits of their last byte."""

    def __init__(self, gram: np.ndarray):
        context = gram >> np.uint64(8)
        self.hash = [mix((context & np.uint64((1 << (8 * o)) - 1)) * np.uint64(8) + np.uint64(o)) for o in range(ORDERS)]
        self.last = gram & np.uint64(255)

    def at(self, order: int, bit: int) -> np.ndarray:
        node = (np.uint64(1) << np.uint64(bit)) | (self.last >> np.uint64(8 - bit))
        return (((self.hash[order] + node * _ODD) * _ODDER) >> np.uint64(64 - SLOT_BITS)).astype(np.int64)

    def bit(self, bit: int) -> np.ndarray:
        return ((self.last >> np.uint64(7 - bit)) & np.uint64(1)).astype(np.int64)


def stretch_of(zeros: np.ndarray, ones: np.ndarray) -> np.ndarray:
    return np.clip(np.log((ones + np.float32(0.4)) / (zeros + np.float32(0.4))), -7.99, 7.99)


def known_of(zeros: np.ndarray, ones: np.ndarray) -> np.ndarray:
    """0, or 1 + log2 of the count."""
    return np.where(zeros + ones > 0, np.log2(np.maximum(zeros + ones, 1)) + 1, 0).astype(np.uint8)


class Mixer:
    """Predictors, gated weights and adaptive maps of the two sets."""

    def __init__(self, counts: np.ndarray):
        self.counts = counts  # float16, zeros and ones of each slot
        self.weights = np.full((2, GATES, ORDERS + 1), 0.25)
        self.weights[:, :, ORDERS] = 0.0
        self.map = np.tile(1 / (1 + np.exp(-_STEPS)), (2, GATES, 1))
        self.stretch: np.ndarray | None = None
        self.seen: tuple[np.ndarray, np.ndarray] | None = None

    def __getstate__(self) -> dict:
        return {**self.__dict__, "stretch": None, "seen": None}

    def prepare(self) -> None:
        """Log odds * 4096 of each slot, and how well it is known; counts are given up."""
        if self.stretch is None:
            n = 1 << SLOT_BITS
            self.stretch, self.known = np.empty(n, np.int16), np.empty(n, np.uint8)
            for a in range(0, n, 1 << 18):
                zeros, ones = self.counts[:, a : a + (1 << 18)].astype(np.float32)
                self.stretch[a : a + (1 << 18)] = np.rint(stretch_of(zeros, ones) * 4096)
                self.known[a : a + (1 << 18)] = known_of(zeros, ones)

    def mixed(self, x: list[np.ndarray], gate: np.ndarray, which: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(mixed, refined, and place in the map) of one set."""
        w = self.weights[which]
        odds = w[gate, ORDERS] * 0.3
        for o in range(ORDERS):
            odds += x[o] * w[gate, o]
        odds = np.clip(odds, -7.99, 7.99)
        p = 1 / (1 + np.exp(-odds))
        step = (odds + 8) * 2
        low = step.astype(np.int64)
        part = step - low
        cell = self.map[which].reshape(-1)
        at = gate * len(_STEPS) + low
        mapped = cell[at] * (1 - part) + cell[at + 1] * part
        return p, np.clip((p + mapped) / 2, 1 / 4096, 1 - 1 / 4096), low, part

    def cost(self, gram: np.ndarray) -> np.ndarray:
        """Bits of each gram's last byte, for both sets."""
        self.prepare()
        out, slots = np.zeros((len(gram), 2)), Slots(gram)
        for bit in range(8):
            at = [slots.at(o, bit) for o in range(ORDERS)]
            x = [self.stretch[s] / 4096 for s in at]
            gate = gate_of(self.known[at[-1]], self.known[at[-2]])
            y = slots.bit(bit)
            for which in (0, 1):
                p = self.mixed(x, gate, which)[1]
                out[:, which] -= np.log2(np.where(y == 1, p, 1 - p))
        return out.astype(np.float32)

    def cached(self, gram: np.ndarray, mixed: np.ndarray) -> np.ndarray:
        """cost() by a table of fixed size."""
        if self.seen is None:
            self.seen = np.full(1 << CACHE_BITS, np.uint64(2**64 - 1)), np.zeros((1 << CACHE_BITS, 2), np.float32)
        keys, costs = self.seen
        at = (mixed >> np.uint64(64 - CACHE_BITS)).astype(np.int64)
        miss = np.flatnonzero(keys[at] != gram)
        new, which = np.unique(gram[miss], return_inverse=True)
        found = self.cost(new)
        out = costs[at]
        out[miss] = found[which.ravel()]
        keys[at[miss]], costs[at[miss]] = gram[miss], out[miss]
        return out

    def texts(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(bits, keys) of the chunks of all texts, and the first chunk of each text."""
        gram, bounds = grams(data, offsets)
        mixed = mix(gram)
        first, keys = chunks(mixed, bounds)
        size = np.diff(np.append(first, len(gram)))
        start = np.flatnonzero((np.arange(len(gram)) - np.repeat(first, size)) % BLOCK == 0)
        blocks = np.add.reduceat(self.cached(gram, mixed).astype(np.float64), start)
        # what the last blocks of the same text cost
        sums = np.concatenate([np.zeros((1, 2)), np.cumsum(blocks, axis=0)])
        text = np.searchsorted(start, bounds)  # first block of each text
        since = np.maximum(np.arange(len(start)) - MEMORY, np.repeat(text[:-1], np.diff(text)))
        recent = sums[np.arange(len(start))] - sums[since]
        share = np.clip(1 / (1 + np.exp2(np.clip(recent[:, 0] - recent[:, 1], -50, 50))), 1 / 64, 63 / 64)
        bits = -np.logaddexp2(np.log2(share) - blocks[:, 0], np.log2(1 - share) - blocks[:, 1])
        return np.add.reduceat(bits, np.searchsorted(start, first)), keys, np.searchsorted(first, bounds)

    def learn(self, gram: np.ndarray, n: np.ndarray, rate: float) -> np.ndarray:
        """A batch of distinct grams and their counts moves weights and maps; gives how many bits each gate saw, by set."""
        slots, seen = Slots(gram), np.zeros((2, GATES))
        for bit in range(8):
            y, x = slots.bit(bit), []
            for o in range(ORDERS):
                zeros, ones = self.counts[:, slots.at(o, bit)].astype(np.float32)
                zeros, ones = np.maximum(zeros - (y == 0), 0), np.maximum(ones - (y == 1), 0)
                x.append(stretch_of(zeros, ones))
                known = known_of(zeros, ones), known if o else None
            gate = gate_of(known[0], known[1][0])
            for which, heavy in enumerate((n.astype(np.float64), np.ones(len(n)))):
                p, _, low, part = self.mixed(x, gate, which)
                total = np.bincount(gate, heavy, GATES)
                error = (y - p) * heavy
                for j in range(ORDERS + 1):
                    self.weights[which, :, j] += rate * np.bincount(gate, error * (x[j] if j < ORDERS else 0.3), GATES) / np.maximum(total, 1e-9)
                cell = gate * len(_STEPS) + low + (part > 0.5)
                flat = self.map[which].reshape(-1)
                times, all_, up = np.bincount(cell, minlength=flat.size), np.bincount(cell, heavy, flat.size), np.bincount(cell, y * heavy, flat.size)
                keep = 0.98 ** np.minimum(times, 200)
                flat[:] = np.where(times > 0, keep * flat + (1 - keep) * up / np.maximum(all_, 1e-9), flat)
                seen[which] += np.bincount(gate, minlength=GATES)
        return seen


def gate_of(high: np.ndarray, next_: np.ndarray) -> np.ndarray:
    return np.digitize(high, (1, 3, 6)) * 3 + np.digitize(next_, (1, 4))


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sums of the tokens, grams and chunks of training texts."""
    kept: dict[int, list] = {TOKEN: [], GRAM: [], CHUNK: []}
    size = dict.fromkeys(kept, 0)

    def summed(kind: int) -> pa.RecordBatch:
        keys, n = (np.concatenate(x) for x in zip(*kept[kind], strict=True))
        order = np.argsort(keys, kind="stable")
        keys, n = keys[order], n[order]
        first = np.flatnonzero(np.append(True, keys[1:] != keys[:-1]))
        return pa.RecordBatch.from_arrays(
            [pa.array(np.full(len(first), kind, np.int8)), pa.array(keys[first].view(np.int64)), pa.array(np.add.reduceat(n, first))], names=["kind", "key", "n"]
        )

    for batch in batches:
        for data, offsets, row in slices(batch["text"]):
            with np.errstate(over="ignore"):
                w = words_of(data, offsets, row)
                gram, bounds = grams(data, offsets)
                new = {TOKEN: np.append(w.hashes, np.full(len(w), END_TOKEN)), GRAM: gram, CHUNK: chunks(mix(gram), bounds)[1]}
            for kind, x in new.items():
                found = np.unique(x, return_counts=True)
                kept[kind].append(found)
                size[kind] += len(found[0])
                if size[kind] > _TAKE_UP:
                    once = summed(kind)
                    kept[kind] = [(once["key"].to_numpy().view(np.uint64), once["n"].to_numpy())]
                    size[kind] = once.num_rows
                    if size[kind] > _TAKE_UP // 2:
                        yield once
                        kept[kind], size[kind] = [], 0
    for kind in kept:
        if kept[kind]:
            yield summed(kind)


def _bit_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(slot, zeros, ones) of the grams of a partition, _TOGETHER at a time."""
    kept, size = [], 0

    def summed() -> pa.RecordBatch:
        gram, n = (np.concatenate(x) for x in zip(*kept, strict=True))
        cells, times = [], []
        with np.errstate(over="ignore"):
            for o in range(ORDERS):
                # shorter contexts repeat
                low = gram & np.uint64((1 << (8 * o + 8)) - 1)
                once, which = np.unique(low, return_inverse=True)
                count, slots = np.bincount(which.ravel(), n), Slots(once)
                for bit in range(8):
                    cells.append(slots.at(o, bit) * 2 + slots.bit(bit))
                    times.append(count)
        cell, count = np.concatenate(cells), np.concatenate(times)
        order = np.argsort(cell)
        cell, count = cell[order], count[order]
        first = np.flatnonzero(np.append(True, cell[1:] >> 1 != cell[:-1] >> 1))
        both = [pa.array(np.add.reduceat(np.where(cell & 1 == y, count, 0), first).astype(np.int64)) for y in (0, 1)]
        return pa.RecordBatch.from_arrays([pa.array((cell[first] >> 1).astype(np.int32)), *both], names=["slot", "zeros", "ones"])

    for batch in batches:
        kept.append((batch["key"].to_numpy().view(np.uint64), batch["n"].to_numpy()))
        size += batch.num_rows
        if size >= _TOGETHER:
            yield summed()
            kept, size = [], 0
    if size:
        yield summed()


#: Grams of a step of learning.
STEP = 10_000


def _learned(sent, rate: float):
    """What the grams of a part make of the weights and maps: (cell, value * bits seen, bits seen)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        start: Mixer = sent.value
        mixer, seen = Mixer(start.counts), np.zeros((2, GATES))
        mixer.weights, mixer.map = start.weights.copy(), start.map.copy()
        held = [(batch["key"].to_numpy().view(np.uint64), batch["n"].to_numpy()) for batch in batches]  # a part has a bounded number of grams
        if held:
            key, n = (np.concatenate(x) for x in zip(*held, strict=True))
            held.clear()
            with np.errstate(over="ignore"):
                # steps follow the grams alone, in whatever order and batches they come
                order = np.argsort(mix(key), kind="stable")
                key, n = key[order], n[order]
                for i, at in enumerate(range(0, len(key), STEP)):
                    seen += mixer.learn(key[at : at + STEP], n[at : at + STEP], rate / (1 + i / 8))
        value = np.concatenate([mixer.weights, mixer.map], axis=2)
        n = np.broadcast_to(seen[:, :, None], value.shape)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(value.size, dtype=np.int32)), pa.array((value * n).ravel()), pa.array(n.ravel())], names=["cell", "value", "n"])

    return run


def _scored(sent):
    """A row for each text: what the head of the vocabulary and the bits give, and its other tokens and its chunks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mixer, head, count, total = sent.value
        uid = TaskContext.get().partitionId() << 40
        for batch in batches:
            for data, offsets, row in slices(batch["text"]):
                with np.errstate(over="ignore"):
                    bits, keys, first_chunk = mixer.texts(data, offsets)
                    w = words_of(data, offsets, row)
                text = np.repeat(np.arange(len(w)), np.diff(w.first))
                token, text = np.append(w.hashes, np.full(len(w), END_TOKEN)), np.append(text, np.arange(len(w)))
                at = np.minimum(np.searchsorted(head, token), max(0, len(head) - 1))
                there = head[at] == token if len(head) else np.zeros(len(token), bool)
                c = np.zeros(len(token), np.int64)
                c[there] = count[at[there]]
                base = np.bincount(text, np.log10((c + 1) / total), len(w))
                known = np.bincount(text[there], minlength=len(w))
                tail, tail_times, tail_cuts = _once(token[~there], text[~there], len(w))
                # how often a text holds each of its chunks
                owner = np.repeat(np.arange(len(w)), np.diff(first_chunk))
                order = np.lexsort((keys, owner))
                new = np.append(True, (keys[order][1:] != keys[order][:-1]) | (owner[order][1:] != owner[order][:-1]))
                own = np.empty(len(keys), np.int32)
                own[order] = np.diff(np.append(np.flatnonzero(new), len(keys)))[np.cumsum(new) - 1]
                cuts = pa.array(first_chunk.astype(np.int32))
                size = np.diff(w.first) + 1
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(uid + np.arange(len(w))),
                        batch["doc_id"].slice(row, len(w)),
                        batch["held_out"].slice(row, len(w)),
                        pa.array(size.astype(np.int64)),
                        pa.array(known.astype(np.int64)),
                        pa.array(base),
                        pa.array(np.add.reduceat(bits, first_chunk[:-1])),
                        pa.array(np.diff(offsets)),
                        pa.ListArray.from_arrays(tail_cuts, tail),
                        pa.ListArray.from_arrays(tail_cuts, tail_times),
                        pa.ListArray.from_arrays(cuts, pa.array(keys.view(np.int64))),
                        pa.ListArray.from_arrays(cuts, pa.array(own)),
                        pa.ListArray.from_arrays(cuts, pa.array(bits.astype(np.float32))),
                    ],
                    names=["uid", "doc_id", "held_out", "n_tokens", "known", "base", "bits", "n_bytes", "tokens", "times", "chunks", "own", "chunk_bits"],
                )
                uid += len(w)

    return run


def _once(token: np.ndarray, text: np.ndarray, n: int) -> tuple[pa.Array, pa.Array, pa.Array]:
    """(tokens, times, bounds): each token of a text once."""
    order = np.lexsort((token, text))
    token, text = token[order], text[order]
    first = np.flatnonzero(np.append(True, (token[1:] != token[:-1]) | (text[1:] != text[:-1]))) if len(token) else np.zeros(0, np.int64)
    times = np.diff(np.append(first, len(token)))
    return pa.array(token[first].view(np.int64)), pa.array(times.astype(np.int32)), pa.array(np.searchsorted(text[first], np.arange(n + 1)).astype(np.int32))


_BLOCK_BITS = 16


def _dense(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts of the slots of a partition, as blocks of 2^16 slots (sorted by slot)."""
    block, counts = -1, None
    for batch in batches:
        slot = batch["slot"].to_numpy()
        n = np.stack([batch["zeros"].to_numpy(), batch["ones"].to_numpy()]).astype(np.float64)
        n *= np.minimum(1, 60_000 / np.maximum(n.max(axis=0), 1))  # float16 ends there; what counts is the ratio
        for b in np.unique(slot >> _BLOCK_BITS):
            if b != block:
                if counts is not None:
                    yield pa.RecordBatch.from_arrays([pa.array([block], pa.int32()), pa.array([counts.tobytes()])], names=["block", "counts"])
                block, counts = int(b), np.zeros((2, 1 << _BLOCK_BITS), np.float16)
            here = slot >> _BLOCK_BITS == b
            counts[:, slot[here] & ((1 << _BLOCK_BITS) - 1)] = n[:, here]
    if counts is not None:
        yield pa.RecordBatch.from_arrays([pa.array([block], pa.int32()), pa.array([counts.tobytes()])], names=["block", "counts"])


def train(docs: DataFrame) -> tuple[Mixer, DataFrame]:
    """(the mixing model, counts kind, key, n of tokens, grams and chunks) of training texts (doc_id, text)."""
    spark = docs.sparkSession
    importable(spark)
    sums = docs.mapInArrow(_counted, "kind tinyint, key bigint, n bigint").groupBy("kind", "key").agg(F.sum("n").alias("n"))
    sums = materialize(sums, "sums")
    found = sums.where(F.col("kind") == GRAM).select("key", "n")
    parts = max(1, -(-found.count() // FOLD))
    near = F.shiftrightunsigned("key", 8).bitwiseAND(F.lit(0xFFFF))  # contexts of an order share their last two bytes
    bits = found.repartition(parts, near, F.shiftrightunsigned("key", 24).bitwiseAND(F.lit(0xFF))).mapInArrow(_bit_counts, "slot int, zeros bigint, ones bigint")
    bits = bits.groupBy("slot").agg(F.sum("zeros").alias("zeros"), F.sum("ones").alias("ones"))
    blocks = bits.repartition(F.shiftright("slot", _BLOCK_BITS)).sortWithinPartitions("slot").mapInArrow(_dense, "block int, counts binary")
    counts = np.zeros((2, 1 << SLOT_BITS), np.float16)
    for r in blocks.toLocalIterator():  # 2^SLOT_BITS slots of 4 bytes at most
        counts[:, r.block << _BLOCK_BITS : (r.block + 1) << _BLOCK_BITS] = np.frombuffer(r.counts, np.float16).reshape(2, -1)
    mixer = Mixer(counts)
    dealt = found.repartition(parts, F.xxhash64("key"))
    for turn in range(ROUNDS):
        sent = spark.sparkContext.broadcast(mixer)
        cells = dealt.mapInArrow(_learned(sent, RATE / (turn + 1)), "cell int, value double, n double").groupBy("cell").agg(F.sum("value").alias("value"), F.sum("n").alias("n"))
        merged = np.concatenate([mixer.weights, mixer.map], axis=2)
        for r in cells.where("n > 0").collect():  # the numbers of a model, however many parts
            merged.reshape(-1)[r.cell] = r.value / r.n
        mixer.weights, mixer.map = merged[:, :, : ORDERS + 1].copy(), merged[:, :, ORDERS + 1 :].copy()
        sent.destroy()
    return mixer, sums


def score(docs: DataFrame, training: DataFrame) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, bits_per_byte) of every row of ``docs``.

    ``training`` has the rows of ``docs`` that are not held out: their own chunks are taken out of the counts.
    """
    spark = docs.sparkSession
    mixer, sums = train(training)
    counts = sums.where(F.col("kind") == TOKEN).select("key", "n")
    n, v = counts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    total = n + v + 1
    all_chunks, single = sums.where(F.col("kind") == CHUNK).agg(F.coalesce(F.sum("n"), F.lit(0)), F.count(F.when(F.col("n") == 1, 1))).first()
    seen = min(max(1 - single / max(all_chunks, 1), 1e-6), 1 - 1e-6)
    head = counts.orderBy(F.col("n").desc(), "key").limit(HEAD).toArrow()
    key, count = head["key"].to_numpy().view(np.uint64), head["n"].to_numpy()
    order = np.argsort(key)
    sent = spark.sparkContext.broadcast((mixer, key[order], count[order], total))
    kind = dict(docs.dtypes)["doc_id"]
    rows = docs.mapInArrow(
        _scored(sent),
        f"uid bigint, doc_id {kind}, held_out boolean, n_tokens bigint, known bigint, base double, bits double, n_bytes bigint, "
        "tokens array<bigint>, times array<int>, chunks array<bigint>, own array<int>, chunk_bits array<float>",
    )
    rows = materialize(rows, "scored")
    tail = rows.select("uid", F.inline(F.arrays_zip("tokens", "times"))).toDF("uid", "key", "times").withColumn("bits", F.lit(0.0).cast("float"))
    mine = rows.select("uid", "held_out", F.inline(F.arrays_zip("chunks", "own", "chunk_bits"))).toDF("uid", "held_out", "key", "own", "bits")
    mine = mine.select("uid", "key", F.when(F.col("held_out"), 0).otherwise(F.col("own")).alias("times"), "bits")
    items = tail.withColumn("kind", F.lit(TOKEN).cast("byte")).unionByName(mine.withColumn("kind", F.lit(CHUNK).cast("byte")))
    found = items.join(sums.where(F.col("kind") != GRAM), ["kind", "key"]).where((F.col("kind") == TOKEN) | (F.col("n") > F.col("times")))
    token = F.col("kind") == TOKEN
    # log2 of how much more likely the table makes a chunk than its bits do
    more = F.log2((F.col("n") - F.col("times")) * F.lit(seen / max(all_chunks, 1))) - F.lit(float(np.log2(1 - seen))) + F.col("bits")
    gain = F.greatest(more, F.lit(0.0)) + F.log2(1 + F.pow(F.lit(2.0), -F.abs(more)))
    rest = found.groupBy("uid").agg(
        F.sum(F.when(token, F.col("times") * F.log10(F.col("n") + 1))).alias("more"),
        F.sum(F.when(token, F.col("times"))).alias("also"),
        F.sum(F.when(~token, gain)).alias("gain"),
    )
    scored = rows.select("uid", "doc_id", "held_out", "n_tokens", "known", "base", "n_bytes", (F.col("bits") - F.size("chunks") * F.lit(float(np.log2(1 - seen)))).alias("bits"))
    bits = F.col("bits") - F.coalesce("gain", F.lit(0.0))
    return scored.join(rest, "uid", "left").select(
        "doc_id", "held_out", "n_tokens",
        (F.col("known") + F.coalesce("also", F.lit(0))).alias("n_known"),
        F.lit(int(n)).cast("long").alias("train_tokens"),
        (F.col("base") + F.coalesce("more", F.lit(0.0))).alias("base_score"),
        (-bits * F.lit(float(np.log10(2)))).alias("score"),
        (bits / F.greatest(F.col("n_bytes"), F.lit(1))).alias("bits_per_byte"),
    )


def held_out(doc_id: str = "doc_id") -> F.Column:
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 7 == 2, F.lit(False))


def op4_logistic_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"), held_out().alias("held_out"))
    return score(docs, docs.where(~F.col("held_out")).select("doc_id", "text"))
