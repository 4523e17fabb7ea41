"""Language ID by a linear-chain conditional random field over words.

Each word has a label, its language. Its features are its character n-grams (2 to 4 bytes, borders included),
its affixes (first and last bytes), itself, and which learned lexicons hold it, all with weights per
language; transitions between labels are learned too. Forward-backward gives each word's posterior over
languages, so a text may switch. A text's language is the one with the largest expected number of words,
and the score is that language's share of them.

The field is fitted by gradient ascent (Adagrad) on SAMPLE texts per language at most, the smallest by hash,
none longer than SAMPLE_BYTES: a bounded sample that the driver holds. Every language is learned; where there are
many, each has fewer texts, so that all have SAMPLED together (one at least). Weights take 1.5 MB a language. The sample's texts are cut into stretches that
are strung together again across languages, so that transitions learn to switch. Prediction runs over
every whole text: the recurrences of all texts of a slice run side by side, as products of small matrices
over equal stretches, then a scan over the stretches.

Defined results: a null text or one without a letter is ``und`` with score 0; where nothing can be learned
(no labelled texts) all are ``und``; ties go to the language that sorts first. Equal rows give equal rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from galley.llm.words import Words, lean, mix, slices, words_of
from galley.tables import importable, table

SAMPLE, SAMPLE_BYTES, SAMPLED = 400, 8_000, 25_600
#: Bytes of text that are scored at once, with up to eight languages; posteriors take a number per word and language.
SLICE = 1 << 20
BITS = 16
EPOCHS, BATCH_WORDS, RATE = 3, 12_000, 0.3
_MASK = np.uint64((1 << BITS) - 1)
#: Feature families: one table of weights each, then the lexicons'.
FAMILIES = ("two", "three", "four", "prefix", "suffix", "word")
LETTERS = np.zeros(256, bool)
LETTERS[[*range(65, 91), *range(97, 123), *range(128, 256)]] = True


def _folded(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Texts apart by blanks, A-Z and the accented capitals after byte 0xC3 lower-cased."""
    n = len(data)
    out = np.full(n + len(offsets) + 4, 32, np.uint8)
    if n:
        own = np.arange(n) + np.repeat(np.arange(1, len(offsets)), np.diff(offsets))
        low = data.copy()
        low[(data >= 65) & (data <= 90)] += 32
        low[1:][(data[:-1] == 0xC3) & (data[1:] >= 0x80) & (data[1:] <= 0x9E)] += 32
        low[(data >= 9) & (data <= 13)] = 32
        out[own] = low
    return out


class Features:
    """Hashed features of a slice's words: per byte those of n-grams, per word the rest."""

    def __init__(self, w: Words, lexicon: tuple[np.ndarray, np.ndarray] | None):
        shift = np.searchsorted(w.offsets, w.start, "right")  # blanks put in before the word
        self.begin, self.end = w.start + shift, w.end + shift
        text = _folded(w.data, w.offsets).astype(np.uint32)
        code = text
        self.grams = []
        for k in (2, 3, 4):
            code = (code[:-1] << np.uint32(8)) | text[k - 1 :]
            self.grams.append(((code * np.uint32(0x9E3779B1)) >> np.uint32(32 - BITS)).astype(np.int64))
        four = code
        self.prefix = ((four[self.begin - 1] * np.uint32(0x85EBCA6B)) >> np.uint32(32 - BITS)).astype(np.int64)
        last = np.maximum(self.end - 3, self.begin - 1)
        self.suffix = ((four[last] * np.uint32(0xC2B2AE35)) >> np.uint32(32 - BITS)).astype(np.int64)
        self.word = (mix(w.hashes) & _MASK).astype(np.int64)
        self.held = None
        if lexicon is not None and len(lexicon[0]):
            at = np.minimum(np.searchsorted(lexicon[0], w.hashes), len(lexicon[0]) - 1)
            self.held = np.where(lexicon[0][at] == w.hashes, lexicon[1][at], -1)

    def emissions(self, weights: dict) -> np.ndarray:
        """Words by languages. A word has the n-grams that begin from the blank before it up to its end."""
        out = np.empty((len(self.begin), len(weights["start"])))
        two, three, four = self.grams
        n = len(four)
        for y in range(out.shape[1]):
            per_byte = weights["two"][y].take(two[:n])
            per_byte += weights["three"][y].take(three[:n])
            per_byte += weights["four"][y].take(four)
            out[:, y] = np.add.reduceat(per_byte, self.begin - 1)
            for name, f in (("prefix", self.prefix), ("suffix", self.suffix), ("word", self.word)):
                out[:, y] += weights[name][y].take(f)
            if self.held is not None:
                out[:, y] += np.append(weights["lexicon"][y], 0.0).take(self.held)
        return out

    def gradient(self, g: np.ndarray, like: dict) -> dict:
        out = {n: np.zeros_like(like[n]) for n in like if n not in ("transition", "start")}
        size, n = 1 << BITS, len(self.grams[2])
        span = np.diff(np.append(self.begin - 1, n))
        for y in range(g.shape[1]):
            for name, f in (("prefix", self.prefix), ("suffix", self.suffix), ("word", self.word)):
                out[name][y] = np.bincount(f, g[:, y], size)
            per_byte = np.repeat(g[:, y], span)
            for name, grams in zip(FAMILIES[:3], self.grams, strict=True):
                out[name][y] = np.bincount(grams[n - len(per_byte) : n], per_byte, size)
            if self.held is not None:
                inside = self.held >= 0
                out["lexicon"][y] = np.bincount(self.held[inside], g[inside, y], len(out["lexicon"]))
        return out


def forward_backward(emission: np.ndarray, first: np.ndarray, transition: np.ndarray, start: np.ndarray, moves: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """(posteriors, expected transitions) of chains that begin at the words ``first``.

    Scores are logarithms. All words stand in one row; a chain's first word takes ``start`` instead of a
    transition. The row is cut into equal stretches, whose matrices are multiplied side by side.
    """
    n, m = emission.shape
    b = np.exp(emission - emission.max(axis=1, keepdims=True))
    a, pi = np.exp(transition), np.exp(start)
    width = max(1, int(np.sqrt(n / 4)))
    count = -(-n // width)
    padded = np.ones((count * width, m))
    padded[:n] = b
    begins = np.zeros(count * width, bool)
    begins[first] = True
    begins[n:] = True
    step_b = padded.reshape(count, width, m).transpose(1, 0, 2)
    step_s = begins.reshape(count, width).T
    whole = np.broadcast_to(np.eye(m), (count, m, m)).copy()
    for t in range(width):
        whole = np.where(step_s[t][:, None, None], whole.sum(axis=2, keepdims=True) * pi, whole @ a) * step_b[t][:, None, :]
        whole /= whole.max(axis=(1, 2), keepdims=True)
    enter, leave = np.zeros((count, m)), np.zeros((count, m))
    now = np.full(m, 1 / m)
    for c in range(count):
        enter[c] = now
        now = now @ whole[c]
        now = now / now.sum()
    now = np.ones(m)
    for c in range(count - 1, -1, -1):
        leave[c] = now
        now = whole[c] @ now
        now = now / now.max()
    alpha, beta = np.empty((width, count, m)), np.empty((width, count, m))
    now = enter
    for t in range(width):
        now = np.where(step_s[t][:, None], now.sum(axis=1, keepdims=True) * pi, now @ a) * step_b[t]
        now = now / now.sum(axis=1, keepdims=True)
        alpha[t] = now
    now = leave
    for t in range(width - 1, -1, -1):
        beta[t] = now
        ahead = step_b[t] * now
        now = np.where(step_s[t][:, None], ahead @ pi[:, None], ahead @ a.T)
        now = now / now.max(axis=1, keepdims=True)
    alpha, beta = (x.transpose(1, 0, 2).reshape(-1, m)[:n] for x in (alpha, beta))
    gamma = alpha * beta
    gamma /= gamma.sum(axis=1, keepdims=True)
    if not moves:
        return gamma, a
    on = np.flatnonzero(~begins[1:n]) + 1
    ahead = b[on] * beta[on]
    norm = np.einsum("ti,ij,tj->t", alpha[on - 1], a, ahead, optimize=True)
    moved = a * ((alpha[on - 1] / norm[:, None]).T @ ahead)
    return gamma, moved


class Model:
    """Weights of the field; plain arrays, a few MB."""

    def __init__(self, languages: list[str]):
        n = len(languages)
        self.languages = languages
        self.weights = {name: np.zeros((n, 1 << BITS), np.float32) for name in FAMILIES}
        self.weights |= {"lexicon": np.zeros((n, n)), "transition": np.zeros((n, n)), "start": np.zeros(n)}
        self.lexicon = (np.zeros(0, np.uint64), np.zeros(0, np.int64))

    def posteriors(self, w: Words) -> np.ndarray:
        e = Features(w, self.lexicon).emissions(self.weights)
        first = w.first[:-1][np.diff(w.first) > 0]
        return forward_backward(e, first, self.weights["transition"], self.weights["start"], moves=False)[0]


def _word_arrays(texts: list[str]) -> Words:
    raw = [t.encode() for t in texts]
    data = np.frombuffer(b"".join(raw), np.uint8)
    with np.errstate(over="ignore"):
        return words_of(data, np.append(0, np.cumsum([len(x) for x in raw])).astype(np.int64))


def fit(samples: list[tuple[str, str]], seed: int = 7) -> Model:
    """The field of (language, text) samples."""
    samples = sorted(samples)
    languages = sorted({x for x, _ in samples})
    model, r = Model(languages), np.random.default_rng(seed)
    number = {x: i for i, x in enumerate(languages)}
    pieces: list[tuple[int, list[str]]] = []
    for language, text in samples:
        tokens, at = text.split(), 0
        while at < len(tokens):
            size = int(r.integers(8, 60))
            pieces.append((number[language], tokens[at : at + size]))
            at += size
    if not pieces or len(languages) < 2:
        return model
    # lexicons: words that a language holds nearly alone, by their hashes
    w = _word_arrays([" ".join(p) for _, p in pieces])
    label = np.repeat([y for y, _ in pieces], np.diff(w.first))
    known, at = np.unique(w.hashes, return_inverse=True)
    count = np.zeros((len(known), len(languages)))
    np.add.at(count, (at.ravel(), label), 1)
    sure = (count.sum(axis=1) >= 4) & (count.max(axis=1) >= 0.9 * count.sum(axis=1))
    model.lexicon = (known[sure], count[sure].argmax(axis=1))
    squares = {k: np.full(v.shape, 1e-6) for k, v in model.weights.items()}
    for _ in range(EPOCHS):
        order, batch, size = r.permutation(len(pieces)), [], 0
        for n, i in enumerate(order):
            batch.append(pieces[i])
            size += len(pieces[i][1])
            if size >= BATCH_WORDS or n == len(order) - 1:
                _step(model, batch, squares, r)
                batch, size = [], 0
    return model


def _step(model: Model, batch: list[tuple[int, list[str]]], squares: dict, r: np.random.Generator) -> None:
    chains, gold, at = [], [], 0
    while at < len(batch):  # strung together across languages
        many = int(r.integers(1, 6))
        chains.append(" ".join(" ".join(p) for _, p in batch[at : at + many]))
        gold += [y for y, p in batch[at : at + many] for _ in p]
        at += many
    w, gold = _word_arrays(chains), np.array(gold)
    if len(w.hashes) != len(gold):
        return  # white space that only one of the two cuts knows
    f = Features(w, model.lexicon)
    first = w.first[:-1][np.diff(w.first) > 0]
    gamma, moved = forward_backward(f.emissions(model.weights), first, model.weights["transition"], model.weights["start"])
    target = np.eye(len(model.languages))[gold]
    g = f.gradient((target - gamma) / 100, model.weights)
    begins = np.zeros(len(gold), bool)
    begins[first] = True
    on = np.flatnonzero(~begins[1:]) + 1
    seen = np.zeros_like(moved)
    np.add.at(seen, (gold[on - 1], gold[on]), 1)
    g |= {"transition": (seen - moved) / 100, "start": (target[first] - gamma[first]).sum(axis=0) / 100}
    for k, v in model.weights.items():
        squares[k] += g[k] ** 2
        v += (RATE * g[k] / np.sqrt(squares[k])).astype(v.dtype)


def _predicted(model, keep_text: bool = False):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import regex

        letter = regex.compile(r"\p{L}")
        m: Model = model.value
        for batch in batches:
            names, scores = [], []
            for data, offsets, row in slices(batch["__text"], SLICE * 8 // max(8, len(m.languages))):
                with np.errstate(over="ignore"):
                    w = words_of(data, offsets, row)
                count = np.append(0, np.cumsum(LETTERS[data]))
                plain = np.append(0, np.cumsum(LETTERS[data] & (data < 128)))
                share = np.zeros((len(w), max(1, len(m.languages))))
                if len(w.hashes) and m.languages:
                    with np.errstate(over="ignore"):
                        gamma = m.posteriors(w)
                    gamma = gamma * (count[w.end] > count[w.start])[:, None]
                    sums = np.zeros((len(gamma) + 1, gamma.shape[1]))
                    np.cumsum(gamma, axis=0, out=sums[1:])
                    share = sums[w.first[1:]] - sums[w.first[:-1]]
                for i in range(len(w)):
                    a, b = offsets[i], offsets[i + 1]
                    total = share[i].sum()
                    lettered = plain[b] > plain[a] or (count[b] > count[a] and letter.search(data[a:b].tobytes().decode()) is not None)
                    if lettered and total > 0:
                        best = int(share[i].argmax())
                        names.append(m.languages[best])
                        scores.append(min(1.0, float(share[i][best] / total)))
                    else:
                        names.append("und")
                        scores.append(0.0)
            keep = [n for n in batch.schema.names if n != "__text"]
            own, named = ([batch["__text"]], ["text"]) if keep_text else ([], [])
            yield pa.RecordBatch.from_arrays([*(batch[n] for n in keep), *own, pa.array(names, pa.string()), pa.array(scores, pa.float64())], names=[*keep, *named, "lang_pred", "score"])

    return run


def training_rows(docs: DataFrame, sample: int = SAMPLE, longest: int = SAMPLE_BYTES, sampled: int = SAMPLED) -> list[tuple[str, str]]:
    """At most ``sample`` labelled texts of each language, ``sampled`` in all (one of each at least): the smallest by hash."""
    able = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & (F.octet_length("text") <= longest) & (F.length(F.trim("text")) > 0))
    languages = able.select("lang").distinct().count()
    each = max(1, min(sample, sampled // max(1, languages)))
    order = Window.partitionBy("lang").orderBy(F.xxhash64("doc_id"), "text")
    # the first rows of a window are found before the shuffle as well, so a frequent language sends few
    rows = able.select("lang", "doc_id", "text").withColumn("n", F.row_number().over(order)).where(F.col("n") <= each)
    return [(r.lang, r.text) for r in rows.select("lang", "text").collect()]


def predict(docs: DataFrame, model: Model, keep_text: bool = False) -> DataFrame:
    """``docs``, without its text unless that is kept, and with lang_pred and score; columns of these names are replaced."""
    from pyspark.sql import types as T

    spark = docs.sparkSession
    importable(spark)
    sent = spark.sparkContext.broadcast(model)
    rest = [c for c in docs.columns if c not in ("text", "lang_pred", "score")]
    rows = docs.select(*[F.col(f"`{c}`") for c in rest], F.col("text").cast("string").alias("__text"))
    own = [T.StructField("text", T.StringType())] if keep_text else []
    schema = T.StructType([*(rows.schema[c] for c in rest), *own, T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])
    return rows.mapInArrow(lean(_predicted(sent, keep_text)), schema)


def held_out(doc_id: str = "doc_id") -> F.Column:
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 3 == 1, F.lit(False))


def op6_crf_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = fit(training_rows(docs.where(~held_out())))
    return predict(docs.select("doc_id", held_out().alias("held_out"), "text"), model)
