"""Near duplicates by exact Jaccard similarity of shingle sets: SimHash fingerprints compared bit-sliced, then verified.

Texts with equal sets of shingles are one node. Nodes meet under BANDS keys of ROWS minima of their shingle
hashes each: a pair at similarity 0.8 meets with probability 1 - (1 - 0.8**4)**28, so about 4 in 10 million such pairs do
not. Then

1. the nodes of a bucket (without texts) are compared bit-sliced, and a node goes on if another one lies within RADIUS bits, has a
   fitting set size and, in a bucket of a later key, shares none of the FIRST keys. RADIUS is wide: at similarity 0.8 about 10 of 64 bits differ;
2. the texts of those nodes come to their block, where a search spreads from node to node over verified pairs: each node is held
   against the nodes not yet reached alone, and one link leaves the task for each component reached. The buckets of the FIRST keys go first;
   of the others only those that still hold several components follow.

Buckets are split into blocks of a bounded number of nodes and bytes that meet two by two, so that no bucket meets in one task.

Defined results: a null text has no words; texts without words are one group; a text with fewer words than a shingle is one
shingle; a null key stays a row and is never the smallest of a group unless alone; rows that share a key stay or go together; an empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import components, cut, discard, kept, release, salted_join, small
from .simhash import planes, within

WORDS, NUMERATOR, DENOMINATOR = 5, 4, 5
BANDS, ROWS, FIRST, RADIUS = 28, 4, 7, 28
BLOCK, BLOCK_BYTES = 1024, 8 << 20

_RANDOM = np.random.Generator(np.random.PCG64(7))
_FACTORS = _RANDOM.integers(0, 1 << 64, BANDS * ROWS, np.uint64) | np.uint64(1)
_TERMS = _RANDOM.integers(0, 1 << 64, BANDS * ROWS, np.uint64)


def shingles(text: bytes, words: int = WORDS) -> np.ndarray:
    """Sorted distinct hashes of the shingles of a UTF-8 text, A-Z lower-cased."""
    found = text.lower().split()
    if not found:
        return np.zeros(0, np.uint64)
    line, digest = b" ".join(found), xxhash.xxh64_intdigest
    if len(found) <= words:
        return np.array([digest(line, 42)], np.uint64)
    ends = np.cumsum(np.fromiter(map(len, found), np.int64, len(found)) + 1)
    starts = [0, *ends[: len(found) - words].tolist()]
    return np.unique(np.array([digest(line[a:b], 42) for a, b in zip(starts, (ends[words - 1 :] - 1).tolist(), strict=True)], np.uint64))


def similar(a: np.ndarray, b: np.ndarray) -> bool:
    """Whether two sets of `shingles` have Jaccard similarity 0.8 or more."""
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both * DENOMINATOR >= (len(a) + len(b) - both) * NUMERATOR


def sketch(found: np.ndarray) -> tuple[int, np.ndarray]:
    """(SimHash, band keys) of a set of shingles."""
    total, least = np.zeros(64, np.int64), np.full(len(_FACTORS), np.uint64(0xFFFFFFFFFFFFFFFF))
    for i in range(0, len(found), 1024):
        part = found[i : i + 1024]
        total += np.unpackbits(part.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
        np.minimum(least, (part[None, :] * _FACTORS[:, None] + _TERMS[:, None]).min(axis=1), out=least)
    keys = [xxhash.xxh64_intdigest(least[ROWS * b : ROWS * (b + 1)].tobytes(), b) for b in range(BANDS)]
    return int.from_bytes(np.packbits(2 * total > len(found)).tobytes(), "big"), np.array(keys, np.uint64)


def sketches(df: DataFrame, key: str, text: str) -> DataFrame:
    """(key, row, node, n, fp, bands): row tells rows apart by key and text, node is the digest of the shingle set and n its size."""
    kind = dict(df.select(key).dtypes)[key]

    def run(batches):
        release()
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                part = batch.slice(at, 1024)
                nodes, sizes, fps, bands = [], [], [], []
                for t in part.column(2):
                    found = shingles((t.as_py() or "").encode())
                    fp, keys = sketch(found)
                    nodes.append(xxhash.xxh3_64_intdigest(found.tobytes()))
                    sizes.append(len(found))
                    fps.append(fp)
                    bands.append(keys)
                long = lambda x: pa.array(np.array(x, np.uint64).view(np.int64))
                keys = pa.ListArray.from_arrays(pa.array(np.arange(len(bands) + 1, dtype=np.int32) * BANDS), long(np.concatenate(bands)))
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), long(nodes), pa.array(sizes, pa.int64()), long(fps), keys], [key, "row", "node", "n", "fp", "bands"])
        release()

    return df.select(key, F.xxhash64(key, text).alias("row"), text).mapInArrow(run, f"`{key}` {kind}, row long, node long, n long, fp long, bands array<long>")


def _fits(a: np.ndarray, b: np.ndarray, n: np.ndarray, early: np.ndarray) -> np.ndarray:
    fits = np.minimum(n[a], n[b]) * DENOMINATOR >= np.maximum(n[a], n[b]) * NUMERATOR
    return fits & ~(early[a] == early[b]).any(axis=1)


def _candidates(g: np.ndarray, n: np.ndarray, fp: np.ndarray, early: np.ndarray, radius: int) -> np.ndarray:
    """Which nodes have another one in their run of equal g within the radius, of a fitting size, and without a common early key."""
    out = np.zeros(len(g), bool)
    begin = np.flatnonzero(np.r_[True, g[1:] != g[:-1]]) if len(g) else np.zeros(0, int)
    size = np.diff(np.r_[begin, len(g)])
    # Small runs share bit-sliced passes whose lanes are their pairs.
    for m in np.unique(size[(size > 1) & (size <= 16)]):
        at = begin[size == m]
        i, j = np.triu_indices(m, 1)
        a, b = (at[:, None] + i).ravel(), (at[:, None] + j).ravel()
        for k in range(0, len(a), 1 << 18):
            x, y = a[k : k + (1 << 18)], b[k : k + (1 << 18)]
            near = np.unpackbits(within(planes(fp[x] ^ fp[y]), np.zeros(1, np.uint64), radius)[0].view(np.uint8), bitorder="little")[: len(x)].astype(bool)
            x, y = x[near], y[near]
            fits = _fits(x, y, n, early)
            out[x[fits]] = out[y[fits]] = True
    for k in np.flatnonzero(size > 16):
        lo, hi = begin[k], begin[k] + size[k]
        base = planes(fp[lo:hi])
        for i in range(lo, hi, 32):
            near = np.unpackbits(within(base, fp[i : min(i + 32, hi)], radius).view(np.uint8), axis=1, bitorder="little")[:, : hi - lo].astype(bool)
            a, b = np.nonzero(near)
            a, b = a + i, b + lo
            out[a[(a != b) & _fits(a, b, n, early)]] = True
    return out


def joined(sets: list[np.ndarray], root: np.ndarray) -> list[tuple[int, int]]:
    """(member, centre) links that connect the sets (`shingles`) exactly as equal roots and all pairs of similarity 0.8 or more do."""
    sizes = np.array([len(x) for x in sets])
    codes = np.unique(np.concatenate(sets), return_inverse=True)[1].astype(np.int32)
    ends = np.cumsum(sizes)
    flag = np.zeros(len(codes) + 1, np.int32)
    left, flat = np.arange(len(sets)), codes  # the nodes not yet reached, and their codes
    links: list[tuple[int, int]] = []
    frontier: list[int] = []
    centre = -1
    while len(left):
        if frontier:
            i = frontier.pop()
            own = codes[ends[i] - sizes[i] : ends[i]]
            flag[own] = 1
            both = np.add.reduceat(flag[flat], np.cumsum(sizes[left]) - sizes[left]).astype(np.int64)
            flag[own] = 0
            near = both * DENOMINATOR >= (sizes[left] + sizes[i] - both) * NUMERATOR
            near = np.isin(root[left], root[left[near]]) if near.any() else near
            reached = left[near]
            links += [(int(j), centre) for j in reached[np.unique(root[reached], return_index=True)[1]]]
        else:
            centre = int(left[0])
            near = root[left] == root[centre]
            reached = left[near]
        frontier += reached.tolist()
        if len(reached):
            flat = flat[np.repeat(~near, sizes[left])]
            left = left[~near]
    return links


def _ended(batches):
    """The batches that hold rows, then None if there was one."""
    some = False
    for batch in batches:
        if batch.num_rows:
            some = True
            yield batch
    if some:
        yield None


def _groups(batches):
    """(g, rows) of each run of equal first columns over Arrow batches sorted by it."""
    rest: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        g = batch.column(0).to_numpy()
        begin = [0, *(np.flatnonzero(g[1:] != g[:-1]) + 1).tolist()]
        if rest and rest[0].column(0)[0].as_py() != g[0]:
            yield pa.Table.from_batches(rest).combine_chunks()
            rest = []
        for a, z in zip(begin, begin[1:], strict=False):
            yield pa.Table.from_batches([*rest, batch.slice(a, z - a)]).combine_chunks()
            rest = []
        rest.append(batch.slice(begin[-1]))
    if rest:
        yield pa.Table.from_batches(rest).combine_chunks()


def active(marks: DataFrame, radius: int) -> DataFrame:
    """(g, first, node): the nodes of `marks` (node, n, fp, bands) with a candidate, once for each block g where they have it; first: under one of the FIRST keys."""
    keyed = marks.select("node", "n", F.posexplode("bands").alias("band", "bucket")).select("node", "n", "bucket", (F.col("band") < FIRST).alias("first"))
    counts = keyed.groupBy("bucket").agg(F.count(F.lit(1)).alias("size"), F.sum("n").alias("total")).where("size > 1")
    blocks = F.ceil(F.greatest(F.col("size") / BLOCK, F.col("total") * 8 / BLOCK_BYTES)).cast("int")
    own = keyed.drop("n").join(counts.select("bucket", blocks.alias("k")), "bucket").withColumn("own", F.pmod(F.xxhash64("node"), "k").cast("int"))
    dealt = own.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("k") - 1)))
    dealt = dealt.select(F.xxhash64("bucket", F.least("own", "other"), F.greatest("own", "other")).alias("g"), "first", "node")
    # Only nodes that meet others get their columns. Under a first key nothing is earlier: there the keys are numbers that no two rows share.
    early = F.when(F.col("first"), F.transform(F.sequence(F.lit(1), F.lit(FIRST)), lambda i: F.xxhash64("node", i))).otherwise(F.slice("bands", 1, FIRST)).alias("early")
    dealt = dealt.join(marks.select("node", "n", "fp", "bands"), "node").select("g", "first", "node", "n", "fp", early)

    def run(batches):
        rest: list[pa.RecordBatch] = []
        for batch in _ended(batches):
            if batch is not None and rest and rest[0].column(0)[0].as_py() == batch.column(0)[-1].as_py():
                rest.append(batch)
                continue
            rows = pa.Table.from_batches([*rest, *([] if batch is None else [batch])], schema=(rest or [batch])[0].schema).combine_chunks()
            g = rows.column(0).to_numpy()
            last = len(g) if batch is None else int(np.searchsorted(g, g[-1]))
            rest = rows.slice(last).to_batches()
            early = rows.column(5).combine_chunks().values.to_numpy().reshape(-1, FIRST)
            hit = _candidates(g[:last], rows.column(3).to_numpy(), rows.column(4).to_numpy().view(np.uint64), early, radius)
            yield from rows.select([0, 1, 2]).slice(0, last).filter(pa.array(hit)).to_batches()

    return dealt.repartition("g").sortWithinPartitions("g").mapInArrow(run, "g long, first boolean, node long")


def verified(met: DataFrame, texts: DataFrame) -> DataFrame:
    """(u, v) links between the nodes of each block of met (g, node, root), whose texts are (node, text)."""

    def run(batches):
        release()
        for rows in _groups(batches):
            node = rows.column(1).to_numpy()
            links = joined([shingles(t.as_py().encode()) for t in rows.column(3)], rows.column(2).to_numpy())
            ends = [pa.array(node[np.array([x[k] for x in links], np.int64)]) for k in (0, 1)]
            yield pa.RecordBatch.from_arrays(ends, ["u", "v"])
        release()

    return met.join(texts, "node").select("g", "node", "root", "text").repartition("g").sortWithinPartitions("g").mapInArrow(run, "u long, v long")


def near_duplicates(df: DataFrame, key: str, text: str, radius: int = RADIUS) -> DataFrame:
    """(key, component): component is the smallest key among all rows reachable over pairs of similarity 0.8 or more."""
    rows = kept(sketches(df, key, text))
    nodes = rows.groupBy("node").agg(F.min(key).alias("least"), F.count(F.lit(1)).alias("copies"))
    # Copies of a node agree in these columns.
    marks = cut(rows.where("n > 0").groupBy("node").agg(F.min("row").alias("row"), F.first("n").alias("n"), F.first("fp").alias("fp"), F.first("bands").alias("bands")))
    met = cut(active(marks, radius))
    needed = cut(met.select("node").distinct().join(marks.select("node", "row"), "node"))
    texts = cut(df.select(F.xxhash64(key, text).alias("row"), F.col(text).alias("text")).join(small(needed), "row").select("node", "text").dropDuplicates(["node"]))
    first = components(verified(met.where("first").select("g", "node", F.col("node").alias("root")), texts))
    rest = met.where("not first").select("g", "node").join(first, "node", "left").select("g", "node", F.coalesce("root", "node").alias("root"))
    open_ = rest.groupBy("g").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo <> hi").select("g")
    found = components(first.select(F.col("node").alias("u"), F.col("root").alias("v")).union(verified(rest.join(open_, "g"), texts)))
    rooted = nodes.join(found, nodes.node == found.node, "left").select(nodes.node, "least", "copies", F.coalesce("root", nodes.node).alias("root"))
    named = rooted.groupBy("root").agg(F.min("least").alias("component"))
    named = cut(rooted.join(named, "root").select("node", "component", "copies"))
    out = cut(salted_join(rows.select(key, "node", "row"), named, "node", "copies", F.col("row")).select(key, "component"))
    rows.unpersist()
    for done in (marks, met, needed, texts):
        discard(done)
    return out


def deduplicate(df: DataFrame, key: str, text: str, radius: int = RADIUS) -> DataFrame:
    """The rows of df whose key is the smallest of their group; rows that share a key stay or go together."""
    stays = near_duplicates(df, key, text, radius).groupBy(key).agg(F.max(F.col(key).eqNullSafe(F.col("component"))).alias("_lamina_stays"))
    gone = cut(stays.where("not _lamina_stays").select(F.col(key).alias("_lamina_gone")))
    return df.join(small(gone), F.col(key).eqNullSafe(F.col("_lamina_gone")), "left_anti")
