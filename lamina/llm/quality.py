"""Quality rules: a hashed word and character n-gram logistic regression with calibrated probabilities.

Three blocks of hashed relative frequencies (words, pairs of words, character trigrams over UTF-8 bytes)
feed one logistic regression. It is fitted in numpy on a bounded sample of labelled rows (the TRAIN_ROWS
labelled doc_ids with the least hash among texts up to TRAIN_BYTES), a fifth of which calibrates it by
Platt's method. All texts are scored whole in Arrow batches; a text is kept if no base rule fails and its probability reaches KEEP.

Defined results: a null text has no words and fails the base rule; labels that are null are not used, and
rows that repeat a doc_id count once; without rows of both classes the model gives probability 1 to
every text; an empty table gives no rows; other input columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents
from .tokens import _VALUE, Words, chunks, mix, per_row, rolling, spans_hash

TRAIN_ROWS, TRAIN_BYTES = 2000, 65536
KEEP = 0.3
BITS = 12
DIM = 3 << BITS
SCALE = 30.0
CHUNK = 1 << 20
_U = np.uint64
_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"#*$%&|<>")] = True


def grams(data: np.ndarray, offsets: np.ndarray, words: Words) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """For each block: feature index of each gram, the first gram of each row (rows + 1 entries), and which grams stay inside a row."""
    shift, size = _U(64 - BITS), 1 << BITS
    one = (words.hashes >> shift).astype(np.int32)
    pair = (rolling(words.hashes, 2) >> shift).astype(np.int32) + size
    whole = words.rows[1:] == words.rows[:-1] if len(words.rows) > 1 else np.zeros(0, bool)
    d = data.astype(np.uint32)
    tri = (d[:-2] * np.uint32(0x9E3779B1) ^ (d[1:-1] * np.uint32(0x85EBCA77)) ^ (d[2:] * np.uint32(0xC2B2AE3D))) if len(d) > 2 else np.zeros(0, np.uint32)
    tri = ((tri * np.uint32(0x27D4EB2F)) >> np.uint32(32 - BITS)).astype(np.int32) + 2 * size
    inside = np.ones(len(tri), bool)
    for k in (1, 2):
        cut = offsets[1:-1] - k
        inside[cut[(cut >= 0) & (cut < len(tri))]] = False
    return [(one, words.first, np.ones(len(one), bool)), (pair, np.minimum(words.first, len(pair)), whole), (tri, np.minimum(offsets, len(tri)), inside)]


def matrix(texts: list[str]) -> np.ndarray:
    """Features of texts, one row each."""
    out = np.zeros((len(texts), DIM), np.float32)
    for lo, hi, data, offsets in chunks(pa.array(texts, pa.string()), CHUNK):
        for index, first, inside in grams(data, offsets, Words(data, offsets)):
            for r in range(hi - lo):
                own = index[first[r] : first[r + 1]][inside[first[r] : first[r + 1]]]
                if len(own):
                    out[lo + r] += np.bincount(own, minlength=DIM).astype(np.float32) * (SCALE / len(own))
    return out


def scores(data: np.ndarray, offsets: np.ndarray, words: Words, weights: np.ndarray) -> np.ndarray:
    """weights . features of each row, without building the features."""
    out = np.zeros(len(offsets) - 1)
    for index, first, inside in grams(data, offsets, words):
        n = per_row(inside.astype(np.int64), first)
        out += per_row(weights[index] * inside, first) * SCALE / np.maximum(n, 1)
    return out


def fit(texts: list[str], labels: list[int], steps: int = 150) -> dict:
    """Weights, and slope and offset of the calibrated logit. The order of rows decides the split, so give them in a fixed order."""
    y = np.array(labels, np.float32)
    if len(y) < 10 or y.min() == y.max():
        return {"weights": np.zeros(DIM), "slope": 0.0, "offset": 50.0}
    x = matrix(texts)
    held = np.arange(len(y)) % 5 == 4
    a, t = x[~held], y[~held]
    balance = np.where(t > 0, 0.5 / max(t.mean(), 1e-6), 0.5 / max(1 - t.mean(), 1e-6)).astype(np.float32) / len(t)
    w, b = np.zeros(DIM, np.float32), np.float32(0)
    m, v = np.zeros(DIM + 1, np.float32), np.zeros(DIM + 1, np.float32)
    for step in range(1, steps + 1):
        p = 1 / (1 + np.exp(-np.clip(a @ w + b, -30, 30)))
        g = (p - t) * balance
        grad = np.r_[a.T @ g + 1e-4 * w, g.sum()]
        m, v = 0.9 * m + 0.1 * grad, 0.99 * v + 0.01 * grad * grad
        move = 0.05 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-7)
        w, b = w - move[:-1].astype(np.float32), b - np.float32(move[-1])
    z, t = (x[held] @ w + b).astype(np.float64), y[held].astype(np.float64)
    slope, offset = 1.0, 0.0
    if 0 < t.sum() < len(t):
        target = np.where(t > 0, (t.sum() + 1) / (t.sum() + 2), 1 / (len(t) - t.sum() + 2))
        s, o, centre, spread = 1.0, 0.0, z.mean(), max(z.std(), 1e-6)
        u = (z - centre) / spread

        def loss(s, o):
            q = s * u + o
            return (np.logaddexp(0, q) - target * q).sum() + 1e-3 * s * s

        for _ in range(100):
            p = 1 / (1 + np.exp(-np.clip(s * u + o, -30, 30)))
            r, h = p - target, p * (1 - p)
            gs, go = (r * u).sum() + 2e-3 * s, r.sum()
            a_, b_, c_ = (h * u * u).sum() + 2e-3, (h * u).sum(), h.sum() + 1e-6
            det, size = a_ * c_ - b_ * b_, 1.0
            ds, do = (c_ * gs - b_ * go) / det, (a_ * go - b_ * gs) / det
            while size > 1e-6 and loss(s - size * ds, o - size * do) > loss(s, o):
                size /= 2
            s, o = s - size * ds, o - size * do
        slope, offset = s / spread, o - s * centre / spread
    return {"weights": w.astype(np.float64), "slope": float(slope), "offset": float(slope * b + offset)}


def train(docs: DataFrame, labels: DataFrame) -> dict:
    """The model of docs (doc_id, text) and labels (doc_id, quality)."""
    known = labels.where("doc_id is not null and quality in (0, 1)").groupBy("doc_id").agg(F.max("quality").alias("quality"))
    # Twice as many ids as rows wanted, as some may be long, repeated or absent: at most 2 * TRAIN_ROWS small rows are broadcast.
    picked = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(2 * TRAIN_ROWS)
    rows = docs.select("doc_id", "text").join(F.broadcast(picked), "doc_id").where(F.octet_length("text") <= TRAIN_BYTES)
    rows = rows.orderBy(F.xxhash64("doc_id"), "doc_id", "text").limit(TRAIN_ROWS).collect()
    return fit([r.text for r in rows], [int(r.quality) for r in rows])


def base(data: np.ndarray, offsets: np.ndarray, words: Words) -> dict[str, np.ndarray]:
    """Counts of each row: n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words."""
    out = {"n_words": np.diff(words.first)}
    out["word_chars"] = per_row(((data & 0xC0) != 0x80) & ~words.space, offsets)
    out["n_symbols"] = per_row(_SYMBOL[data], offsets)
    # Lines: the row's text cut at each \n.
    n_rows = len(offsets) - 1
    breaks = np.flatnonzero(data == 10)
    row_of_break = np.searchsorted(offsets, breaks, "right") - 1
    starts = np.concatenate([offsets[:-1], breaks + 1])
    ends = np.concatenate([breaks, offsets[1:]])
    row = np.concatenate([np.arange(n_rows), row_of_break])
    order = np.lexsort((starts, row))
    starts, row = starts[order], row[order]
    order = np.lexsort((ends, np.concatenate([row_of_break, np.arange(n_rows)])))
    ends = ends[order]
    worded = np.searchsorted(words.starts, ends) > np.searchsorted(words.starts, starts)
    key = mix(spans_hash(_VALUE[data], starts, ends) ^ mix(row.astype(_U) + _U(1)))
    out["n_dup_lines"] = np.bincount(row[worded & _again(key)], minlength=n_rows)
    # Words in windows of five that the row has twice or more.
    five = rolling(words.hashes, 5)
    covered = np.zeros(len(words.hashes) + 1, np.int64)
    if len(five):
        at = np.flatnonzero(words.rows[4:] == words.rows[:-4])
        key = mix(five[at] ^ mix(words.rows[at].astype(_U) + _U(1)))
        order = np.argsort(key, kind="stable")
        same = key[order][1:] == key[order][:-1]
        twice = np.zeros(len(at), bool)
        twice[order[1:][same]] = True
        twice[order[:-1][same]] = True
        np.add.at(covered, at[twice], 1)
        np.add.at(covered, at[twice] + 5, -1)
    out["n_repeat_words"] = per_row(np.cumsum(covered)[:-1] > 0, words.first)
    return out


def _again(key: np.ndarray) -> np.ndarray:
    """Which entries equal an earlier one."""
    order = np.argsort(key, kind="stable")
    out = np.zeros(len(key), bool)
    out[order[1:][key[order][1:] == key[order][:-1]]] = True
    return out


_COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def judge(docs: DataFrame, model: dict, key: str = "doc_id", text: str = "text", keep: float = KEEP) -> DataFrame:
    """(key, the five counts, base_failed, kept, probability) of each row."""
    kind = dict(docs.select(key).dtypes)[key]
    weights, slope, offset = model["weights"].astype(np.float32), model["slope"], model["offset"]

    def run(batches):
        for batch in batches:
            for lo, hi, data, offsets in chunks(batch.column(1), CHUNK):
                words = Words(data, offsets)
                c = base(data, offsets, words)
                failed = (c["n_words"] < 10) | (100 * c["n_repeat_words"] > 20 * c["n_words"])
                p = 1 / (1 + np.exp(-np.clip(slope * scores(data, offsets, words, weights) + offset, -50, 50)))
                arrays = [batch.column(0).slice(lo, hi - lo), *[pa.array(c[k].astype(np.int64)) for k in _COUNTS], pa.array(failed), pa.array(~failed & (p >= keep)), pa.array(p.round(4))]
                yield pa.RecordBatch.from_arrays(arrays, [key, *_COUNTS, "base_failed", "kept", "probability"])

    return docs.select(key, text).mapInArrow(run, f"`{key}` {kind}, {', '.join(f'{k} long' for k in _COUNTS)}, base_failed boolean, kept boolean, probability double")


def keep_rows(docs: DataFrame, model: dict, text: str = "text", keep: float = KEEP) -> DataFrame:
    """The rows of docs that `judge` keeps, with all their columns."""
    weights, slope, offset = model["weights"].astype(np.float32), model["slope"], model["offset"]
    at = docs.columns.index(text)

    def run(batches):
        for batch in batches:
            for lo, hi, data, offsets in chunks(batch.column(at), CHUNK):
                words = Words(data, offsets)
                c = base(data, offsets, words)
                p = 1 / (1 + np.exp(-np.clip(slope * scores(data, offsets, words, weights) + offset, -50, 50)))
                yield batch.slice(lo, hi - lo).filter(pa.array((c["n_words"] >= 10) & (100 * c["n_repeat_words"] <= 20 * c["n_words"]) & (p >= keep)))

    return docs.mapInArrow(run, docs.schema)


def op5_ngram_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    return judge(docs, train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))
