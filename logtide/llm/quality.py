"""Quality classifier from weak labels.

Heuristic labellers vote good, bad or nothing on each document. They overlap
and err, and nobody says how often: expectation-maximisation over the counts
of vote patterns estimates, for good and for bad documents, how often each
labeller votes what, and the share of good documents. From these follow each
labeller's accuracy and the posterior of each vote pattern. The posterior is a
document's soft label, and a linear scorer over hashed features of the text
learns from those. The scorer is not told the votes, and judges every document
by its text alone.

The vote patterns are at most 3 ** len(LABELLERS) rows; the scorer is fitted on
at most ``SAMPLE`` documents, chosen by a hash of their text from all of them,
of which only hashed features reach the driver. Everything else covers every
row.
"""

from __future__ import annotations

import unicodedata
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as C

#: Most documents that the scorer is fitted on.
SAMPLE = 2000
FEATURES = 1 << 16
#: Bytes that a text counts for besides its own, so that short texts are judged with less certainty.
SMOOTH = 50
#: Where estimation begins: the share of good documents.
PRIOR = 0.7
#: Votes of each kind that each labeller is taken to have cast besides those seen.
PSEUDO = 0.5
#: A document is rejected where the scorer's probability of good is below this.
LEAST = 0.5

#: Labellers and the accuracy with which estimation begins.
LABELLERS = (("symbols", 0.95), ("letters", 0.95), ("bars", 0.95), ("capitals", 0.95), ("shouting", 0.95), ("repeats", 0.95), ("doubles", 0.95), ("variety", 0.95), ("sentences", 0.75))

_SYMBOL = np.isin(np.arange(256), np.frombuffer(b"#$%&*^~|<>{}[]\\", np.uint8))
_STOP = np.isin(np.arange(256), np.frombuffer(b".?!", np.uint8))
_WHITE = np.isin(np.arange(256), [32, 9, 10, 11, 12, 13])


@cache
def _categories() -> tuple[np.ndarray, np.ndarray]:
    """Which code points are letters, and which capitals (Unicode categories L and Lu)."""
    kinds = np.array([unicodedata.category(chr(c)) for c in range(0x110000)])
    return np.strings.startswith(kinds, "L"), kinds == "Lu"


def _code_points(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where the characters beyond ASCII begin in UTF-8 bytes, and their code points."""
    at = np.flatnonzero(data >= 0xC0)
    padded = np.append(data, np.zeros(3, np.uint8)).astype(np.int32)
    lead, b, c, d = (padded[at + k] & (0xFF if k == 0 else 0x3F) for k in range(4))
    two, three, four = (lead & 0x1F) << 6 | b, (lead & 0x0F) << 12 | b << 6 | c, (lead & 0x07) << 18 | b << 12 | c << 6 | d
    return at, np.where(lead < 0xE0, two, np.where(lead < 0xF0, three, four))


def votes(column: pa.Array) -> np.ndarray:
    """Votes of a whole column, see ``_votes``; a part of the texts at a time, so that a worker stays small."""
    return np.concatenate([_votes(part) for part in C.slices(column)])


def _votes(column: pa.Array) -> np.ndarray:
    """Votes (rows: texts, columns: LABELLERS): 1 good, -1 bad, 0 none.

    Letters and capitals count by their Unicode category. Null texts are empty
    and get no vote.
    """
    data, offsets = C.text_buffer(column)
    starts, ends, first = C.word_bounds(data, offsets)
    n_texts = len(offsets) - 1

    def count(flags: np.ndarray, bounds: np.ndarray = offsets) -> np.ndarray:
        sums = np.zeros(len(flags) + 1, np.int64)
        np.cumsum(flags, out=sums[1:])
        return sums[bounds[1:]] - sums[bounds[:-1]]

    after = np.append(data[1:], np.uint8(32))
    ends_text = np.zeros(len(data), bool)
    ends_text[offsets[1:][np.diff(offsets) > 0] - 1] = True
    letter, capital = _categories()
    at, points = _code_points(data)
    is_letter, is_capital = ((flags[:256] & (np.arange(256) < 128))[data] for flags in (letter, capital))
    is_letter[at], is_capital[at] = letter[points], capital[points]
    chars, letters, capitals = count((data & 0xC0) != 0x80), count(is_letter), count(is_capital)
    symbols, shouts, stops = count(_SYMBOL[data]), count((data == 33) & (after == 33) & ~ends_text), count(_STOP[data] & (_WHITE[after] | ends_text))
    words, hashes = np.diff(first), C.word_hashes(data, starts, ends)
    rows = np.repeat(np.arange(n_texts), words)
    bars = count((ends - starts == 1) & (data[np.minimum(starts, max(len(data) - 1, 0))] == 124), first) if len(starts) else np.zeros(n_texts, np.int64)
    twin = np.zeros(len(hashes), bool)
    twin[1:] = (hashes[1:] == hashes[:-1]) & (rows[1:] == rows[:-1])
    run = twin.copy()  # the fifth or a later one of a row of equal words
    for k in range(1, 4):
        run[k:] &= twin[:-k]
        run[:k] = False
    order = np.lexsort((hashes, rows))
    new = np.ones(len(order), bool)
    new[1:] = (hashes[order][1:] != hashes[order][:-1]) | (rows[order][1:] != rows[order][:-1])
    kinds = np.bincount(rows[order][new], minlength=n_texts)
    bad = {
        "symbols": symbols > 0.02 * chars,
        "letters": letters < 0.6 * chars,
        "bars": bars > 0.05 * words,
        "capitals": capitals > 0.3 * letters,
        "shouting": shouts > 0.05 * words,
        "repeats": count(run, first) > 0,
        "doubles": (count(twin, first) > 0.05 * words) & (words > 8),
        "variety": (kinds < 0.4 * words) & (words > 8),
        "sentences": (stops == 0) & (words > 20),
    }
    good = {"sentences": (stops >= 0.01 * words) & (stops <= 0.3 * words) & (words > 0)}
    none = np.zeros(n_texts, bool)
    return np.stack([np.where(bad[name], -1, np.where(good.get(name, none), 1, 0)) for name, _ in LABELLERS], 1) if n_texts else np.zeros((0, len(LABELLERS)), np.int64)


def _code(cast: np.ndarray) -> np.ndarray:
    """A vote pattern as one number."""
    return (cast + 1) @ 3 ** np.arange(len(LABELLERS))


def fit_labellers(patterns: np.ndarray, counts: np.ndarray, start: np.ndarray, rounds: int = 200, prior: float = PRIOR) -> tuple[np.ndarray, np.ndarray]:
    """EM over vote patterns (rows of -1, 0, 1): (accuracies, posteriors of good).

    Given the class, labellers vote independently, each with its own
    probabilities of the three votes; not to vote tells something, too.
    ``start`` and ``prior`` say where estimation begins: a vote is believed as
    often as ``start``, no vote tells nothing. A labeller's accuracy is the share
    of its votes that go to their class; without votes it stays ``start``.
    """
    patterns, counts = np.asarray(patterns, np.int64).reshape(-1, len(start)), np.asarray(counts, float)
    cast = patterns[:, :, None] == np.array([-1, 0, 1])  # pattern, labeller, vote
    weigh = np.log(start / (1 - start))
    good = 1 / (1 + np.exp(-np.clip(patterns @ weigh + np.log(prior / (1 - prior)), -50, 50)))
    for _ in range(rounds):
        mass = np.stack([counts * (1 - good), counts * good])  # class, pattern
        rates = np.einsum("cp,pjv->cjv", mass, cast) + PSEUDO
        rates = np.log(rates / rates.sum(2, keepdims=True))
        share = np.log(mass.sum(1) + PSEUDO)
        odds = share[1] - share[0] + np.einsum("pjv,jv->p", cast, rates[1] - rates[0])
        new = 1 / (1 + np.exp(-np.clip(odds, -50, 50)))
        done = np.abs(new - good).max(initial=0) < 1e-9
        good = new
        if done:
            break
    right = (counts * good) @ cast[:, :, 2] + (counts * (1 - good)) @ cast[:, :, 0]
    voted = counts @ (cast[:, :, 2] | cast[:, :, 0])
    return np.where(voted > 0, right / np.maximum(voted, 1e-9), start), good


def _hashed(kind: int, values: np.ndarray) -> np.ndarray:
    """Multiplicative hash of small numbers to FEATURES (a power of two) slots."""
    return ((values.astype(np.uint64) * np.uint64(4) + np.uint64(kind)) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(65 - FEATURES.bit_length())).astype(np.int64)


def _features(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashed features of texts: the text, the feature and how much it counts, one after the other.

    Of bytes, every three in a row; of words, their shape (length, first and
    last byte's kind) and whether they repeat one of the four words before.
    """
    n_texts = len(offsets) - 1
    size = np.diff(offsets)
    rows = np.repeat(np.arange(n_texts), size)
    inner = np.arange(len(data)) - offsets[:-1][rows]
    wide = data.astype(np.int64)
    one, two = np.full(len(data), 32, np.int64), np.full(len(data), 32, np.int64)
    one[1:], two[2:] = wide[:-1], wide[:-2]
    one[inner < 1], two[inner < 2] = 32, 32  # a text begins as if behind spaces
    grams = _hashed(0, two << 16 | one << 8 | wide)
    starts, ends, first = C.word_bounds(data, offsets)
    words, hashes = np.diff(first), C.word_hashes(data, starts, ends)
    row = np.repeat(np.arange(n_texts), words)
    shape = np.minimum(ends - starts, 24) * 64 + _KIND[data[starts]] * 8 + _KIND[data[ends - 1]] if len(starts) else np.zeros(0, np.int64)
    found = [(rows, grams), (row, _hashed(1, shape))]
    for back in range(1, 5):
        twin = np.zeros(len(hashes), bool)
        twin[back:] = (hashes[back:] == hashes[:-back]) & (row[back:] == row[:-back])
        found.append((row[twin], np.full(int(twin.sum()), int(_hashed(2, np.array([back]))[0]))))
    weight = 1 / (size + SMOOTH)
    texts = np.concatenate([t for t, _ in found])
    # a word counts as much as a few bytes, a repeat as much as a few words
    heavy = np.concatenate([np.full(len(t), (1.0, 4.0, 24.0)[min(k, 2)]) for k, (t, _) in enumerate(found)])
    return texts, np.concatenate([f for _, f in found]), weight[texts] * heavy


#: Kinds of bytes: letters, capitals, digits, ends of sentences, other signs, other.
_KIND = np.array([1 if chr(c) in "abcdefghijklmnopqrstuvwxyz" else 2 if chr(c) in "ABCDEFGHIJKLMNOPQRSTUVWXYZ" else 3 if chr(c) in "0123456789" else 4 if chr(c) in ".?!" else 5 if c < 128 else 6 for c in range(256)])


def _scores(weights: np.ndarray, bias: float, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    texts, features, share = _features(data, offsets)
    return bias + np.bincount(texts, share * weights[features], len(offsets) - 1)


def fit_scorer(rows: np.ndarray, cols: np.ndarray, share: np.ndarray, good: np.ndarray, rounds: int = 300, rate: float = 0.1, decay: float = 1e-3) -> tuple[np.ndarray, float]:
    """Logistic regression on hashed features (row, feature, share of each) to soft labels; (weights, bias).

    Gradient descent with per-feature steps over the whole sample; features are scaled by their spread.
    """
    n = len(good)
    used, cols = np.unique(cols, return_inverse=True)
    spread = np.sqrt(np.bincount(cols, share**2, len(used)) / max(n, 1)) + 1e-3
    x = share / spread[cols]
    w, b = np.zeros(len(used)), 0.0
    g2 = np.full(len(used), 1e-8)
    b2 = 1e-8
    for _ in range(rounds):
        z = b + np.bincount(rows, x * w[cols], n)
        err = (good - 1 / (1 + np.exp(-np.clip(z, -30, 30)))) / max(n, 1)
        grad = np.bincount(cols, x * err[rows], len(used)) - decay * w
        g2 += grad**2
        b2 += err.sum() ** 2
        w += rate * grad / np.sqrt(g2)
        b += rate * err.sum() / np.sqrt(b2)
    weights = np.zeros(FEATURES)
    weights[used] = w / spread
    return weights, b


def _sampled(parts: list[pa.Array]) -> pa.Array:
    """Each text's distinct features and their shares."""
    out = []
    for part in parts:
        data, offsets = C.text_buffer(part)
        texts, features, share = _features(data, offsets)
        key, inverse = np.unique(texts * FEATURES + features, return_inverse=True)
        share = np.bincount(inverse, share, len(key)).astype(np.float32)
        ends = np.append(0, np.cumsum(np.bincount(key // FEATURES, minlength=len(part)))).astype(np.int32)
        out.append(pa.StructArray.from_arrays([pa.ListArray.from_arrays(pa.array(ends), pa.array((key % FEATURES).astype(np.int32))), pa.ListArray.from_arrays(pa.array(ends), pa.array(share))], ["cols", "share"]))
    return pa.concat_arrays(out)


def classify_quality(docs: DataFrame, text_col: str = "text", sample: int = SAMPLE) -> DataFrame:
    """``row`` (all columns of ``docs``, whatever their names), ``quality_weak`` (posterior of the votes), ``quality_score`` (the scorer's probability of good) and ``quality_good``; a row for each row.

    A null or empty text is no document worth keeping: its scores are 0. Equal
    texts have equal scores, so ties and repeated rows fare alike. An empty
    table gives no rows.
    """
    spark = docs.sparkSession
    C.session_batches(spark)
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), F.col(f"`{text_col}`").alias("text"))
    texts = C.own(docs, text=text_col)

    @F.arrow_udf("int")
    def pattern(text: pa.Array) -> pa.Array:
        return pa.array(_code(votes(text)).astype(np.int32))

    patterns = texts.select(pattern("text").alias("pattern")).groupBy("pattern").agg(F.count("*").alias("n")).orderBy("pattern").collect()  # 3 ** 9 rows at most
    codes = np.array([r.pattern for r in patterns], np.int64)
    table = codes[:, None] // 3 ** np.arange(len(LABELLERS)) % 3 - 1
    _, posterior = fit_labellers(table, np.array([r.n for r in patterns], float), np.array([a for _, a in LABELLERS]))
    known = np.full(3 ** len(LABELLERS), 0.5)
    known[codes] = posterior

    @F.arrow_udf("struct<cols: array<int>, share: array<float>>")
    def sampled(text: pa.Array) -> pa.Array:
        return _sampled(C.slices(text))

    # the sample: least hashes of the text among all documents; a text counts once
    drawable = texts.where(F.length("text") > 0).select(F.xxhash64("text").alias("h"), "text")
    least = drawable.select("h").distinct().orderBy("h").limit(sample)  # at most ``sample`` numbers
    drawn = drawable.join(F.broadcast(least), "h").groupBy("h").agg(F.min("text").alias("text"))
    found = drawn.select("h", sampled("text").alias("f"), pattern("text").alias("pattern")).orderBy("h").toArrow()
    weights, bias = np.zeros(FEATURES), 0.0
    if found.num_rows:
        part = found.column("f").combine_chunks()
        cols, share = part.field("cols"), part.field("share")
        row = np.repeat(np.arange(found.num_rows), np.diff(cols.offsets.to_numpy()))
        weights, bias = fit_scorer(row, cols.flatten().to_numpy().astype(np.int64), share.flatten().to_numpy().astype(np.float64), known[found.column("pattern").to_numpy()])

    @F.arrow_udf("double")
    def score(column: pa.Array) -> pa.Array:
        out = []
        for text in C.slices(column):
            data, offsets = C.text_buffer(text)
            out.append(np.where(np.diff(offsets) > 0, 1 / (1 + np.exp(-np.clip(_scores(weights, bias, data, offsets), -30, 30))), 0.0))
        return pa.array(np.concatenate(out))

    @F.arrow_udf("double")
    def weak(text: pa.Array) -> pa.Array:
        full = np.diff(C.text_buffer(text)[1]) > 0
        return pa.array(np.where(full, known[_code(votes(text))], 0.0))

    judged = rows.select("row", weak("text").alias("quality_weak"), score("text").alias("quality_score"))
    return judged.withColumn("quality_good", F.col("quality_score") >= LEAST)
