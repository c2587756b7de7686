"""Near duplicates by SimHash with bit-sliced comparison.

Fingerprints are made per text (Arrow batches). Distinct fingerprints then meet under every choice of
enough of their equal bands (two of four 16-bit bands for a radius of 2), so no pair within the radius is missed. Inside
a bucket, bit planes are stored vertically: lane i of plane b is bit b of fingerprint i. A query adds the
64 difference planes into carry-save counters, which keeps many distances at once in bitwise words, and
abandons a block (a word of 64 lanes) as soon as every lane exceeds the radius. Buckets beyond BLOCK fingerprints are split into
blocks that meet two by two in tasks of their own. Only a star of links per block leaves a task.

Defined results: a null text has no words; a text without words has fingerprint zero, which links like
any other; copies share a fingerprint and so a group; a null doc_id stays a row and is never the smallest
of a group unless alone; an empty table gives no rows; other input columns are ignored; a key column named fp or component
comes back as _lamina_key.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import components, cut, documents, release, salted_join

BLOCK = 8192
RADIUS = 2


def fingerprint(text: bytes, words: int) -> int:
    """SimHash of a UTF-8 text over shingles of so many words, A-Z lower-cased."""
    found = text.lower().split()
    if not found:
        return 0
    n = len(found) - words + 1
    if n < 2:
        hashes = xxhash.xxh64_digest(b" ".join(found), 42)
        n = 1
    else:
        line, digest = b" ".join(found), xxhash.xxh64_digest
        ends = np.cumsum(np.fromiter(map(len, found), np.int64, len(found)) + 1)
        starts = [0, *ends[: n - 1].tolist()]
        hashes = b"".join([digest(line[a:b], 42) for a, b in zip(starts, (ends[words - 1 :] - 1).tolist(), strict=True)])
    total = np.zeros(64, np.int64)
    for i in range(0, n, 65536):
        part = np.frombuffer(hashes, np.uint8)[8 * i : 8 * (i + 65536)]
        total += np.unpackbits(part.reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * total > n).tobytes(), "big")


def _output(key: str) -> str:
    return "_lamina_key" if key in ("fp", "component") else key


def fingerprints(df: DataFrame, key: str, text: str, words: int) -> DataFrame:
    """(_lamina_key, fp): the fingerprint's 64 bits as a long."""
    kind = dict(df.select(key).dtypes)[key]

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                part = batch.slice(at, 1024)
                fps = [fingerprint((t.as_py() or "").encode(), words) for t in part.column(1)]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(np.array(fps, np.uint64).view(np.int64))], ["_lamina_key", "fp"])
        release()

    return df.select(key, text).mapInArrow(run, f"_lamina_key {kind}, fp long")


def planes(fps: np.ndarray) -> np.ndarray:
    """64 bit planes of uint64 fingerprints, in words of 64 lanes; lanes past the end are zero."""
    n = len(fps)
    lanes = np.zeros(-(-n // 64) * 64, ">u8")
    lanes[:n] = fps
    bits = np.unpackbits(lanes.view(np.uint8).reshape(-1, 8), axis=1)
    return np.ascontiguousarray(np.packbits(bits.T, axis=1, bitorder="little")).view("<u8")


def within(base: np.ndarray, queries: np.ndarray, radius: int, work: list[int] | None = None) -> np.ndarray:
    """Bits (queries x words of lanes): lane i is set if fingerprint i of `base` (planes) is within radius of the query. After every eight
    planes the blocks (a query and a word of 64 lanes) of which all lanes exceed the radius are abandoned. work: gets the number of blocks that read each plane."""
    full = np.uint64(0xFFFFFFFFFFFFFFFF)
    q, w = len(queries), base.shape[1]
    flip = np.where((queries[:, None] >> np.arange(63, -1, -1, dtype=np.uint64)) & np.uint64(1), full, np.uint64(0))
    live = None  # numbers (query * words + word) of the blocks still open; None: all
    count = [np.zeros(q * w, np.uint64) for _ in range(max(1, (radius + 1).bit_length()))]
    over = np.zeros(q * w, np.uint64)
    out = np.zeros(q * w, np.uint64)

    def beyond() -> np.ndarray:
        more, same = over.copy(), np.full(len(over), full)
        for j in reversed(range(len(count))):
            if radius >> j & 1:
                same &= count[j]
            else:
                more |= same & count[j]
                same &= ~count[j]
        return more

    for b in range(64):
        carry = (base[b][None, :] ^ flip[:, b, None]).ravel() if live is None else base[b][word] ^ flip[query, b]
        if work is not None:
            work.append(len(carry))
        for c in count:
            c_and = c & carry
            c ^= carry
            carry = c_and
        over |= carry
        if b % 8 == 7:
            near = ~beyond()
            stay = near != 0
            if b == 63:
                out[live if live is not None else slice(None)] = near
            elif not stay.any():
                break
            elif not stay.all():
                live = np.flatnonzero(stay) if live is None else live[stay]
                query, word = np.divmod(live, w)
                count, over = [c[stay] for c in count], over[stay]
    return out.reshape(q, w)


def stars(fps: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """(node, centre) links that join each group of the distinct fingerprints linked within radius."""
    nodes, centres = [], []
    base, open_ = planes(fps), np.ones(len(fps), bool)
    left, frontier, centre = len(fps), fps[:0], None
    while left:
        if not len(frontier):
            at = int(np.argmax(open_))
            centre, frontier = fps[at], fps[at : at + 1]
            open_[at] = False
            left -= 1
            continue
        step, frontier = frontier[:32], frontier[32:]
        hit = np.bitwise_or.reduce(within(base, step, radius), axis=0)
        near = np.unpackbits(hit.view(np.uint8), bitorder="little")[: len(fps)].astype(bool) & open_
        found = fps[near]
        open_ &= ~near
        left -= len(found)
        nodes.append(found)
        centres.append(np.full(len(found), centre, np.uint64))
        frontier = np.concatenate([frontier, found])
        if 2 * left < len(fps):  # lanes that are done leave
            fps, base = fps[open_], planes(fps[open_])
            open_ = np.ones(len(fps), bool)
    return (np.concatenate(nodes), np.concatenate(centres)) if nodes else (fps[:0], fps[:0])


def _links(groups: np.ndarray, fps: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Links inside each run of equal `groups`. Small groups share one bit-sliced pass whose lanes are their pairs."""
    begin = np.flatnonzero(np.r_[True, groups[1:] != groups[:-1]]) if len(groups) else np.zeros(0, int)
    size = np.diff(np.r_[begin, len(groups)])
    us, vs = [], []
    for n in np.unique(size[(size > 1) & (size <= 16)]):
        at = begin[size == n]
        i, j = np.triu_indices(n, 1)
        a, b = fps[(at[:, None] + i).ravel()], fps[(at[:, None] + j).ravel()]
        for k in range(0, len(a), 1 << 18):
            x, y = a[k : k + (1 << 18)], b[k : k + (1 << 18)]
            hit = within(planes(x ^ y), np.zeros(1, np.uint64), radius)[0]
            mask = np.unpackbits(hit.view(np.uint8), bitorder="little")[: len(x)].astype(bool)
            us.append(x[mask])
            vs.append(y[mask])
    for k in np.flatnonzero(size > 16):
        u, v = stars(np.unique(fps[begin[k] : begin[k] + size[k]]), radius)
        us.append(u)
        vs.append(v)
    return (np.concatenate(us), np.concatenate(vs)) if us else (fps[:0], fps[:0])


def links(fps: DataFrame, radius: int) -> DataFrame:
    """(u, v): links that connect the distinct fingerprints (column fp: long) exactly as all pairs within radius would. radius: up to 6."""
    bands, keep = {0: (4, 4), 1: (4, 3), 2: (4, 2), 3: (8, 5), 4: (8, 4), 5: (8, 3), 6: (8, 2)}[radius]
    width = 64 // bands
    choices = []
    for k, pick in enumerate(combinations(range(bands), keep)):
        mask = sum(((1 << width) - 1) << width * b for b in pick)
        signed = mask - (1 << 64) if mask >> 63 else mask
        choices.append(F.xxhash64(F.col("fp").bitwiseAND(F.lit(signed).cast("long")), F.lit(k)))
    keyed = fps.select("fp", F.explode(F.array(*choices)).alias("bucket"))
    counts = keyed.groupBy("bucket").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    blocks = F.ceil(F.col("n") / BLOCK).cast("int")
    own = F.pmod(F.xxhash64("fp"), blocks).cast("int")
    met = keyed.join(counts, "bucket").withColumn("k", blocks).withColumn("own", own)
    dealt = met.select("fp", "bucket", "own", F.explode(F.sequence(F.lit(0), F.col("k") - 1)).alias("other")).select("fp", F.xxhash64("bucket", F.least("own", "other"), F.greatest("own", "other")).alias("g"))

    def run(batches):
        rest_g, rest_f = np.zeros(0, np.int64), np.zeros(0, np.uint64)
        for batch in batches:
            g = np.concatenate([rest_g, batch.column(0).to_numpy()])
            f = np.concatenate([rest_f, batch.column(1).to_numpy().view(np.uint64)])
            last = int(np.searchsorted(g, g[-1])) if len(g) else 0
            rest_g, rest_f = g[last:], f[last:]
            u, v = _links(g[:last], f[:last], radius)
            yield pa.RecordBatch.from_arrays([pa.array(u.view(np.int64)), pa.array(v.view(np.int64))], ["u", "v"])
        u, v = _links(rest_g, rest_f, radius)
        yield pa.RecordBatch.from_arrays([pa.array(u.view(np.int64)), pa.array(v.view(np.int64))], ["u", "v"])

    return dealt.select("g", "fp").repartition("g").sortWithinPartitions("g").mapInArrow(run, "u long, v long")


def near_duplicates(df: DataFrame, key: str, text: str, words: int = 3, radius: int = RADIUS) -> DataFrame:
    """(key, fp, component): component is the smallest key among all rows reachable over links within radius."""
    prints = cut(fingerprints(df, key, text, words))
    own = F.col("_lamina_key")
    distinct = cut(prints.groupBy("fp").agg(F.min(own).alias("least"), F.count(F.lit(1)).alias("copies")))
    found = components(links(distinct.select("fp"), radius))
    rooted = distinct.join(found, distinct.fp == found.node, "left").select("fp", "least", "copies", F.coalesce("root", "fp").alias("root"))
    named = rooted.groupBy("root").agg(F.min("least").alias("component"))
    out = salted_join(prints, cut(rooted.join(named, "root").select("fp", "component", "copies")), "fp", "copies", F.xxhash64(own))
    return out.select(own.alias(_output(key)), "fp", "component")


def deduplicate(df: DataFrame, key: str, text: str, words: int = 3, radius: int = RADIUS) -> DataFrame:
    """The rows of df whose key is the smallest of their group; rows that share a key stay or go together."""
    found = near_duplicates(df, key, text, words, radius)
    kept = found.where(F.col(_output(key)).eqNullSafe(F.col("component"))).select(F.col(_output(key)).alias("_lamina_kept")).distinct()
    return df.join(kept, F.col(key).eqNullSafe(F.col("_lamina_kept")), "left_semi")


def op7_simhash_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = near_duplicates(documents(spark, sf_dir), "doc_id", "text")
    return rows.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), F.col("component").alias("component_id"))
