"""Substring dedup by compacted De Bruijn edges.

The edges of the graph are the windows of `size` consecutive words; a window stands once, at its earliest
start, and every later one is a repeat. Three steps find all repeats without dealing out every edge:

1. Compaction. Each window is anchored by its least k-mer hash. A run of consecutive windows of one document
   with the same anchor is a nonbranching path and becomes one compacted edge, named by its anchor and
   the hash of all its words. Windows repeated inside one chunk of documents are settled there.
2. Matching. Compacted edges meet by anchor. Of equal ones all but the earliest are repeats as a whole. An anchor with
   one distinct edge is settled; where several distinct edges share an anchor the path branches, and
   only the earliest coordinate of each is expanded into its windows. Anchors of over a thousandth of all edges (a common phrase with
   different words around it) are known beforehand: their edges are dealt by anchor and words, and count as branching.
3. Verification and expansion. The source coordinates lead back to the words, in one pass over the texts: a
   matched edge counts only if the words at its own and at its source's place have equal digests (XXH3, apart from
   the hashes that matched them), and expanded windows meet by their hash, all but the earliest being repeats.

Hot passages leave a chunk once, so a passage that a third of all documents hold meets as often as there
are chunks, and its source is read once however many ask for it. Edges travel in packs of columns, dealt by anchor into a number of buckets that follows the size of
the input. Repeats inside a chunk are verified there, word hash by word hash; expanded windows must agree in two 64-bit hashes of their
words. A matched edge whose digest differs is no repeat; for that, different words need equal hashes under an equal anchor.

Defined results: a null text has no words; documents are ordered by doc_id, a null one last; rows that
share a doc_id are one document in that order, and of windows with equal (doc_id, start) none is later
than the other; a key that is no integer is ordered by its own type's order; an empty table gives no rows; other input columns are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, dealt, discard, documents
from .tokens import Words, chunks, mix, rolling, spans_hash

SIZE, ANCHOR = 20, 6
CHUNK = 1 << 22
HOT_SAMPLE, HOT_EDGES = 16, 100_000
BUCKET_BYTES = 64 << 20
_U, _LAST = np.uint64, np.iinfo(np.int64).max


def _ids(column: pa.Array) -> np.ndarray:
    return column.cast(pa.int64()).fill_null(_LAST).to_numpy(zero_copy_only=False)


def _least(x: np.ndarray, width: int) -> np.ndarray:
    """Minimum of x[i : i + width]."""
    done = 1
    while done < width:
        step = min(done, width - done)
        x = np.minimum(x[:-step], x[step:])
        done += step
    return x


def windows(words: Words, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(word index, hash) of each window that stays in its row."""
    hashes = rolling(words.hashes, size)
    if not len(hashes):
        return np.zeros(0, np.int64), hashes
    at = np.flatnonzero(words.rows[size - 1 :] == words.rows[: len(words.rows) - size + 1])
    return at, hashes[at]


def later(hashes: np.ndarray, ids: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which entries come after the least (id, start) of their hash, and the entry that is the least."""
    order = np.lexsort((starts, ids, hashes))
    h, d, s = hashes[order], ids[order], starts[order]
    head = np.r_[True, h[1:] != h[:-1]] if len(h) else np.zeros(0, bool)
    lead = np.flatnonzero(head)[np.cumsum(head) - 1] if len(h) else np.zeros(0, int)
    out, first = np.zeros(len(h), bool), np.zeros(len(h), np.int64)
    out[order] = (d > d[lead]) | (s > s[lead])
    first[order] = order[lead]
    return out, first


def _same_words(hashes: np.ndarray, a: np.ndarray, b: np.ndarray, size: int) -> np.ndarray:
    """Whether the windows from words a and from words b agree in every word's hash."""
    out = np.ones(len(a), bool)
    for k in range(size):
        out &= hashes[a + k] == hashes[b + k]
    return out


def _runs(joined: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(first, length) of runs, where joined[i] says that i continues i - 1."""
    first = np.flatnonzero(~joined)
    return first, np.diff(np.r_[first, len(joined)])


_KINDS = {"a": np.uint64, "b": np.uint64, "d": np.int64, "t": np.int32, "s": np.int32, "n": np.int32}


def _pack(columns: dict[str, np.ndarray]) -> bytes:
    """Hashes as they are, then the other columns as byte planes, compressed; documents as steps from one to the next."""
    wide, small = [], []
    for k, t in _KINDS.items():
        if k in columns:
            x = np.ascontiguousarray(columns[k], t)
            if k in "ab":
                wide.append(x.tobytes())
            else:
                x = np.diff(x, prepend=t(0)) if k == "d" else x
                small.append(x.view(np.uint8).reshape(-1, x.itemsize).T.tobytes())
    return b"".join(wide) + zstandard.compress(b"".join(small), 3)


def _unpack(packs: list[bytes], counts: list[int], keys: str) -> dict[str, np.ndarray]:
    out: dict[str, list[np.ndarray]] = {k: [] for k in keys}
    for pack, n in zip(packs, counts, strict=True):
        at = 8 * n * sum(k in "ab" for k in keys)
        raw = pack[:at] + zstandard.decompress(pack[at:])
        at = 0
        for k in keys:
            size = np.dtype(_KINDS[k]).itemsize
            part = np.frombuffer(raw, np.uint8, n * size, at)
            x = part.view(_KINDS[k]) if k in "ab" else np.ascontiguousarray(part.reshape(size, n).T).view(_KINDS[k]).ravel()
            out[k].append(np.cumsum(x) if k == "d" else x)
            at += n * size
    return {k: np.concatenate(v) if v else np.zeros(0, _KINDS[k]) for k, v in out.items()}


def _deal(columns: dict[str, np.ndarray], by: np.ndarray, buckets: int):
    """(bucket, rows, pack) of the columns, split by hash."""
    bucket = (by % _U(buckets)).astype(np.int64)
    order = np.argsort(bucket, kind="stable")
    edge = np.flatnonzero(np.r_[True, np.diff(bucket[order]) != 0]) if len(order) else np.zeros(0, int)
    for a, b in zip(edge, np.r_[edge[1:], [len(order)] * bool(len(order))].astype(int), strict=True):
        own = order[a:b]
        yield int(bucket[own[0]]), len(own), _pack({k: v[own] for k, v in columns.items()})


_PACKS = pa.schema([("bucket", pa.int64()), ("kind", pa.int32()), ("rows", pa.int64()), ("pack", pa.binary())])
_PACKS_DDL = "bucket long, kind int, rows long, pack binary"
EDGES, REPEATS, DIGESTS, HOT = 0, 1, 2, 5


def _packs(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(_PACKS.types)], _PACKS.names)


def _edges_of(words: Words, at: np.ndarray, size: int, anchor: int, again: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(least, follows, first, n): the anchor of each window, whether it continues the one before, and the runs that are edges."""
    row = words.rows[at]
    least = _least(rolling(words.hashes, anchor), size - anchor + 1)[at]
    follows = np.r_[False, (at[1:] == at[:-1] + 1) & (row[1:] == row[:-1])]
    f, n = _runs(follows & ~again & np.r_[False, ~again[:-1]] & np.r_[False, least[1:] == least[:-1]])
    keep = ~again[f]
    return least, follows, f[keep], n[keep]


def hot_anchors(docs: DataFrame, key: str, text: str, size: int, anchor: int) -> np.ndarray:
    """Anchors of over a thousandth of all edges, by a look at one document in HOT_SAMPLE: under 1,000. They tell where edges are dealt to; results do not depend on them."""

    def run(batches):
        for batch in batches:
            for _, _, data, offsets in chunks(batch.column(0), CHUNK):
                words = Words(data, offsets)
                at, _ = windows(words, size)
                if len(at):
                    least, _, f, _ = _edges_of(words, at, size, anchor, np.zeros(len(at), bool))
                    a, n = np.unique(least[f], return_counts=True)
                    some = n > max(2, len(f) // 20_000)
                    yield pa.RecordBatch.from_arrays([pa.array(np.r_[a[some].view(np.int64), 0]), pa.array(np.r_[n[some], 0]), pa.array(np.r_[n[some] * 0, len(f)])], ["a", "n", "edges"])

    sample = docs.where(F.pmod(F.xxhash64(key, text), F.lit(HOT_SAMPLE)) == 0).select(text)
    counts = cut(sample.mapInArrow(run, "a long, n long, edges long").groupBy("a").agg(F.sum("n").alias("n"), F.sum("edges").alias("edges")))
    total = counts.agg(F.sum("edges")).first()[0] or 0
    hot = counts.where(F.col("n") > max(HOT_EDGES // HOT_SAMPLE, total // 1000)).select("a").collect()
    discard(counts)
    return np.sort(np.array([r.a for r in hot], np.int64).view(np.uint64))


def compacted_edges(docs: DataFrame, key: str, text: str, size: int, anchor: int, buckets: int, hot: np.ndarray) -> DataFrame:
    """Packs of compacted edges (a: anchor, b: words, d: document, t: hash of its text, s: start, n: windows), those of hot anchors as HOT, and of the windows settled as repeats (d, t, s, n)."""

    def run(batches):
        for batch in batches:
            ids, texts = _ids(batch.column(0)), batch.column(2).to_numpy()
            for lo, hi, data, offsets in chunks(batch.column(1), CHUNK):
                words = Words(data, offsets)
                at, hashes = windows(words, size)
                if not len(at):
                    continue
                row = words.rows[at]
                doc, text_, start = ids[lo:hi][row], texts[lo:hi][row], at - words.first[row]
                again, lead = later(hashes, doc, start)
                again[again] = _same_words(words.hashes, at[again], at[lead[again]], size)
                least, next_, ef, en = _edges_of(words, at, size, anchor, again)
                rows = []
                f, n = _runs(next_ & again & np.r_[False, again[:-1]])
                keep = again[f]
                f, n = f[keep], n[keep]
                if len(f):
                    rows.append((int(hashes[0] % _U(buckets)), REPEATS, len(f), _pack({"d": doc[f], "t": text_[f], "s": start[f], "n": n})))
                whole = spans_hash(words.hashes, at[ef], at[ef] + en + size - 1)
                columns = {"a": least[ef], "b": whole, "d": doc[ef], "t": text_[ef], "s": start[ef], "n": en}
                burns = np.isin(least[ef], hot)
                for kind, own, by in ((EDGES, ~burns, least[ef]), (HOT, burns, least[ef] ^ mix(whole))):
                    rows += [(b, kind, m, p) for b, m, p in _deal({k: v[own] for k, v in columns.items()}, by[own], buckets)]
                yield _packs(rows)

    return docs.select(key, text, F.hash(text)).mapInArrow(run, _PACKS_DDL)


_SPANS_DDL = "doc long, t int, start int, n int, state int, source_doc long, source_t int, source_start int"
SETTLED, OPEN, MATCHED = 0, 1, 2


def matched_edges(packs: DataFrame) -> DataFrame:
    """(doc, t, start, n, state, source_doc, source_t, source_start): windows known as repeats (SETTLED), windows that equal those at the source
    (MATCHED), and windows that must be expanded because their anchor branches (OPEN)."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        edges, known = pdf[pdf.kind.isin((EDGES, HOT))], pdf[pdf.kind == REPEATS]
        r = _unpack(known.pack.tolist(), known.rows.tolist(), "dtsn")
        e = _unpack(edges.pack.tolist(), edges.rows.tolist(), "abdtsn")
        hot = np.repeat(edges.kind.to_numpy() == HOT, edges.rows.to_numpy())
        order = np.lexsort((e["s"], e["d"], e["b"], e["a"]))
        e = {k: v[order] for k, v in e.items()}
        a, b, d, s = e["a"], e["b"], e["d"], e["s"]
        if len(a):
            head_a = np.r_[True, a[1:] != a[:-1]]
            head = head_a | np.r_[True, b[1:] != b[:-1]]
            lead = np.flatnonzero(head)[np.cumsum(head) - 1]
            repeat = (d > d[lead]) | (s > s[lead])
            group = np.cumsum(head_a) - 1
            branches = (np.bincount(group[head])[group] > 1) | hot[order]
            open_ = branches & ~repeat
        else:
            repeat = open_ = np.zeros(0, bool)
            lead = np.zeros(0, int)
        pick = repeat | open_
        state = np.where(open_[pick], OPEN, MATCHED)
        from_ = lead[pick]
        own = {"doc": d[pick], "t": e["t"][pick], "start": s[pick], "n": e["n"][pick], "state": state, "source_doc": d[from_], "source_t": e["t"][from_], "source_start": s[from_]}
        none = np.zeros(len(r["d"]), np.int64)
        known = {"doc": r["d"], "t": r["t"], "start": r["s"], "n": r["n"], "state": none + SETTLED, "source_doc": none, "source_t": none, "source_start": none}
        return pd.DataFrame({k: np.r_[known[k], own[k]] for k in own})

    return packs.groupBy("bucket").applyInPandas(run, _SPANS_DDL)


OWN, SOURCE = 3, 4


def reread_words(docs: DataFrame, spans: DataFrame, key: str, text: str, size: int, buckets: int, total: int) -> DataFrame:
    """Packs of the windows in OPEN spans (a, b: hashes, d, t, s), and of the digests of both places of MATCHED ones (a: source, b: digest, d, t, s, n;
    n is 0 at the source), from the words at their coordinates."""
    matched = spans.where(F.col("state") == MATCHED)
    pair = F.xxhash64("source_doc", "source_t", "source_start", "n")
    asked = spans.where(F.col("state") == OPEN).select("doc", "t", "start", "n", F.lit(OPEN).alias("what"), F.lit(0).cast("long").alias("pair"))
    asked = asked.union(matched.select("doc", "t", "start", "n", F.lit(OWN), pair)).union(matched.select("source_doc", "source_t", "source_start", "n", F.lit(SOURCE), pair))
    # A set: a source is asked for once, so a text's spans are bounded by its own length.
    wanted = asked.groupBy("doc", "t").agg(F.collect_set(F.struct("start", "n", "what", "pair")).alias("spans"))
    rows = docs.select(F.coalesce(F.col(key), F.lit(_LAST)).alias("doc"), F.hash(text).alias("t"), F.col(text).alias("text"))
    joined = dealt(rows, total, "doc", "t").join(wanted, ["doc", "t"]).select("doc", "t", "text", "spans")

    def run(batches):
        for batch in batches:
            ids, texts = _ids(batch.column(0)), batch.column(1).to_numpy()
            for lo, hi, data, offsets in chunks(batch.column(2), CHUNK):
                words = Words(data, offsets)
                at, hashes = windows(words, size)
                if not len(at):
                    continue
                spans = batch.column(3).slice(lo, hi - lo)
                inner = spans.flatten()
                per = np.repeat(np.arange(hi - lo), pc.list_value_length(spans).to_numpy(zero_copy_only=False))
                s, n, what, pair = (inner.field(k).to_numpy(zero_copy_only=False).astype(np.int64) for k in range(4))
                mark = np.zeros(len(words.hashes) + 1, np.int64)
                begin = words.first[per] + s
                open_ = what == OPEN
                np.add.at(mark, np.minimum(begin[open_], len(words.hashes)), 1)
                np.add.at(mark, np.minimum((begin + n)[open_], len(words.hashes)), -1)
                own = (np.cumsum(mark) > 0)[at]
                other = rolling(words.hashes ^ _U(0x5555555555555555), size)[at[own]]
                at, hashes = at[own], hashes[own]
                row = words.rows[at]
                rows = [(b, EDGES, m, p) for b, m, p in _deal({"a": hashes, "b": other, "d": ids[lo:hi][row], "t": texts[lo:hi][row], "s": at - words.first[row]}, hashes, buckets)]
                pick = np.flatnonzero(~open_)
                if len(pick):
                    # Words joined by one space, so that other white space between them makes no difference.
                    raw = data.tobytes()
                    a, z = words.starts, words.ends
                    digest = np.zeros(len(pick), np.uint64)
                    for i, (f, m) in enumerate(zip(begin[pick].tolist(), (n[pick] + size - 1).tolist(), strict=True)):
                        digest[i] = xxhash.xxh3_64_intdigest(b" ".join(raw[a[f] : z[f + m - 1]].split()))
                    r = per[pick]
                    columns = {"a": pair[pick].view(np.uint64), "b": digest, "d": ids[lo:hi][r], "t": texts[lo:hi][r], "s": s[pick], "n": np.where(what[pick] == OWN, n[pick], 0)}
                    rows += [(b, DIGESTS, m, p) for b, m, p in _deal(columns, columns["a"], buckets)]
                yield _packs(rows)

    return joined.mapInArrow(run, _PACKS_DDL)


def confirmed(packs: DataFrame) -> DataFrame:
    """(doc, t, start, n): expanded windows that start earlier elsewhere, and matched spans whose words have the digest of their source's."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        opened, digests = pdf[pdf.kind == EDGES], pdf[pdf.kind == DIGESTS]
        w = _unpack(opened.pack.tolist(), opened.rows.tolist(), "abdts")
        again, lead = later(w["a"] ^ (w["b"] * _U(0x9E3779B97F4A7C15)), w["d"], w["s"])
        again &= (w["a"] == w["a"][lead]) & (w["b"] == w["b"][lead])
        v = _unpack(digests.pack.tolist(), digests.rows.tolist(), "abdtsn")
        order = np.lexsort((v["n"], v["a"]))
        v = {k: x[order] for k, x in v.items()}
        # The source comes first among those that ask for it; rows that repeat a document give equal entries.
        head = np.r_[True, v["a"][1:] != v["a"][:-1]] if len(order) else np.zeros(0, bool)
        source = np.flatnonzero(head)[np.cumsum(head) - 1] if len(order) else np.zeros(0, int)
        good = (v["n"] > 0) & (v["n"][source] == 0) & (v["b"] == v["b"][source])
        return pd.DataFrame({"doc": np.r_[w["d"][again], v["d"][good]], "t": np.r_[w["t"][again], v["t"][good]], "start": np.r_[w["s"][again], v["s"][good]], "n": np.r_[np.ones(int(again.sum()), np.int32), v["n"][good]]})

    return packs.groupBy("bucket").applyInPandas(run, "doc long, t int, start int, n int")


def text_bytes(docs: DataFrame, text: str) -> int:
    return docs.agg(F.sum(F.octet_length(text))).first()[0] or 0


def repeats(docs: DataFrame, key: str, text: str, size: int = SIZE, anchor: int = ANCHOR, total: int | None = None) -> DataFrame:
    """(doc, t, start, n): runs of n windows of `size` words, from word `start` on, whose words also start earlier. A null key is the largest long; t is the text's hash. total: bytes of all texts, if known."""
    if not 1 <= anchor < size:
        raise ValueError("anchor must be shorter than size")
    total = text_bytes(docs, text) if total is None else total
    buckets = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-total // BUCKET_BYTES))
    hot = hot_anchors(docs, key, text, size, anchor)
    spans = cut(matched_edges(compacted_edges(docs, key, text, size, anchor, buckets, hot)))
    found = confirmed(reread_words(docs, spans, key, text, size, buckets, total))
    return spans.where(F.col("state") == SETTLED).select("doc", "t", "start", "n").union(found)


def remove_repeats(docs: DataFrame, key: str, text: str, size: int = SIZE, anchor: int = ANCHOR) -> DataFrame:
    """(key, n_words, n_removed, kept_sha256, kept): kept is the words left, joined by spaces."""
    kind = dict(docs.select(key).dtypes)[key]
    if kind not in ("bigint", "int", "smallint", "tinyint"):
        # Numbers in the order of the keys: partitions are ranges, sorted inside.
        ranges = docs.select(F.col(key).alias("_lamina_key")).where(F.col(key).isNotNull()).distinct().repartitionByRange("_lamina_key").sortWithinPartitions("_lamina_key")
        numbers = cut(ranges.withColumn("_lamina_id", F.monotonically_increasing_id()))
        whole = docs.select(key, text).join(numbers, F.col(key) == F.col("_lamina_key"), "left").select(F.col("_lamina_id"), F.col(text).alias("_lamina_text"))
        out = remove_repeats(whole, "_lamina_id", "_lamina_text", size, anchor)
        return out.join(numbers, "_lamina_id", "left").select(F.col("_lamina_key").alias(key), "n_words", "n_removed", "kept_sha256", "kept")
    total = text_bytes(docs, text)
    spans = repeats(docs, key, text, size, anchor, total).groupBy("doc", "t").agg(F.collect_list(F.struct("start", "n")).alias("spans"))
    rows = docs.select(key, F.coalesce(F.col(key), F.lit(_LAST)).alias("_doc"), F.hash(text).alias("_t"), text)
    joined = dealt(rows, total, "_doc", "_t").join(spans.withColumnsRenamed({"doc": "_doc", "t": "_t"}), ["_doc", "_t"], "left").select(key, text, "spans")

    def run(batches):
        for batch in batches:
            for i in range(0, batch.num_rows, 1000):
                part = batch.slice(i, 1000)
                texts, spans = part.column(1).to_pylist(), part.column(2)
                begin = spans.offsets.to_numpy()
                inner = spans.values
                starts, lengths = inner.field(0).to_numpy(zero_copy_only=False), inner.field(1).to_numpy(zero_copy_only=False)
                valid = spans.is_valid().to_pylist()
                out = []
                for r, t in enumerate(texts):
                    words = (t or "").encode().split()
                    n = len(words)
                    if valid[r]:
                        s, m = starts[begin[r] : begin[r + 1]].astype(np.int64), lengths[begin[r] : begin[r + 1]].astype(np.int64)
                        mark = np.zeros(n + 1, np.int64)
                        np.add.at(mark, np.minimum(s, n), 1)
                        np.add.at(mark, np.minimum(s + m + size - 1, n), -1)
                        words = [w for w, c in zip(words, (np.cumsum(mark)[:-1] > 0).tolist(), strict=True) if not c]
                    kept = b" ".join(words)
                    out.append((n, n - len(words), hashlib.sha256(kept).hexdigest(), kept.decode()))
                types = [pa.int64(), pa.int64(), pa.string(), pa.string()]
                yield pa.RecordBatch.from_arrays([part.column(0), *[pa.array([o[k] for o in out], t) for k, t in enumerate(types)]], [key, "n_words", "n_removed", "kept_sha256", "kept"])

    return joined.mapInArrow(run, f"`{key}` {kind}, n_words long, n_removed long, kept_sha256 string, kept string")


def op9_debruijn_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(documents(spark, sf_dir), "doc_id", "text").select("doc_id", "n_words", "n_removed", "kept_sha256")


# Rows that share a doc_id cannot be told apart here, so this needs unique doc_ids, as in the test tables.
OP9_SQL = f"""
WITH t AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS ws FROM documents),
w AS (SELECT doc_id, unnest(ws) AS word, generate_subscripts(ws, 1) AS i FROM t),
g AS (SELECT doc_id, unnest(range(1, len(ws) - {SIZE - 2})) AS i, ws FROM t WHERE len(ws) >= {SIZE}),
k AS (SELECT doc_id, i, array_to_string(ws[i:i + {SIZE - 1}], ' ') AS win FROM g),
r AS (SELECT doc_id, i, row_number() OVER (PARTITION BY win ORDER BY doc_id, i) > 1 AS again FROM k),
m AS (
  SELECT w.doc_id, w.word, w.i, coalesce(max(r.again::INT) OVER (PARTITION BY w.doc_id ORDER BY w.i ROWS BETWEEN {SIZE - 1} PRECEDING AND CURRENT ROW), 0) AS gone
  FROM w LEFT JOIN r ON r.doc_id = w.doc_id AND r.i = w.i),
s AS (SELECT doc_id, count(*) AS n_words, sum(gone)::BIGINT AS n_removed, coalesce(string_agg(word, ' ' ORDER BY i) FILTER (WHERE gone = 0), '') AS kept FROM m GROUP BY doc_id)
SELECT d.doc_id, coalesce(s.n_words, 0) AS n_words, coalesce(s.n_removed, 0) AS n_removed, sha256(coalesce(s.kept, '')) AS kept_sha256
FROM documents d LEFT JOIN s USING (doc_id)
"""
