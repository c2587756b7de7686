"""SentencePiece encoding and decoding as a relational lattice.

Texts are cut into words at places that no piece crosses (before a run of marks that follows another character,
and around line feeds). Each Arrow batch sends its distinct words once, dealt by hash; over the distinct
words of all texts the bounded-length substrings are exploded, equi-joined to the piece table, grouped
back by word, and folded by a Spark higher-order `aggregate` over bit masks of cuts: a unigram model by Viterbi (the best
sum of scores), a BPE model by its merges, since the best sum of scores is not what a BPE model encodes. The cut masks then go back to the batches
that sent the words, and each text's pieces become ids there, with byte fallback for unknown characters.

A BPE fold takes the edges of a word once, best score first: an edge whose ends are both cuts loses its inner cuts. That equals merging the
best pair again and again wherever every piece, cut by better pieces alone, ends up in two parts (`Model.odd` lists those that do
not, such as runs of marks with equal scores; words that hold one are folded pair by pair).

The piece table is bounded by the model and broadcast. Words of more than LONGEST characters (a mask is
one long) are cut in Python where they stand: by a heap of merges in O(n log n) for BPE, by Viterbi for unigram models.

Defined results: a null or empty text has no ids and decodes to the empty text; repeated rows give equal ids;
an empty table gives no rows; other input columns are ignored; a mark in the text itself decodes as a space, as the model cannot tell
them apart. Ids are stored as little-endian numbers.
"""

from __future__ import annotations

import functools
import heapq

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, release
from .tokens import _VALUE, spans_hash

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
MARK = "▁"
LONGEST = 61
BATCH_BYTES = 8 << 20
BUCKET_BYTES, TASKS, GROUPS_PER_TASK = 4 << 20, 1 << 15, 4
GATHER, ROWS = 1 << 16, 100
_MARK = MARK.encode()


def _fields(data: bytes) -> dict[int, list]:
    """Fields of a protocol buffer message, by number."""
    out: dict[int, list] = {}
    at = 0

    def varint() -> int:
        nonlocal at
        value = shift = 0
        while True:
            b = data[at]
            at += 1
            value |= (b & 127) << shift
            shift += 7
            if b < 128:
                return value

    while at < len(data):
        key = varint()
        kind = key & 7
        if kind == 0:
            value: object = varint()
        else:
            size = {1: 8, 5: 4}[kind] if kind in (1, 5) else varint()
            value, at = data[at : at + size], at + size
        out.setdefault(key >> 3, []).append(value)
    return out


class Model:
    """Pieces and settings of a SentencePiece model file; only what encoding needs."""

    def __init__(self, path: str = MODEL):
        import sentencepiece

        with open(path, "rb") as f:
            raw = f.read()
        proto = _fields(raw)
        trainer, normal = _fields(proto[2][0]), _fields(proto.get(3, [b""])[0])
        self.bpe = trainer.get(3, [1])[0] == 2
        if normal.get(2, [b""])[0] or normal.get(4, [1])[0] or not normal.get(5, [1])[0]:
            raise ValueError("only models without character map and without white space removal")
        self.prefix = bool(normal.get(3, [1])[0])
        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        n = sp.get_piece_size()
        self.unknown = sp.unk_id()
        self.names = [sp.id_to_piece(i) for i in range(n)]
        special = [sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i) for i in range(n)]
        byte = [sp.is_byte(i) for i in range(n)]
        self.bytes = {int(self.names[i][3:5], 16): i for i in range(n) if byte[i]}
        self.ids = {self.names[i]: i for i in range(n) if not special[i] and not byte[i]}
        self.scores = {p: sp.get_score(i) for p, i in self.ids.items()}
        self.plain = [b"" if special[i] else bytes([int(self.names[i][3:5], 16)]) if byte[i] else self.names[i].replace(MARK, " ").encode() for i in range(n)]
        self.longest = max(map(len, self.ids))
        self.stored = "<u2" if n <= 1 << 16 else "<u4"
        if any("\n" in p or MARK in p.lstrip(MARK) for p in self.ids):
            raise ValueError("a piece crosses words")

    @functools.cached_property
    def odd(self) -> frozenset[str]:
        """Pieces that better ones alone do not cut into two parts."""

        def parts(p: str) -> int:
            inner = {p[i:j] for i in range(len(p)) for j in range(i + 2, len(p) + 1)}
            return len(merge_long(p, {q: self.scores[q] for q in inner if q in self.scores and self.scores[q] > self.scores[p]}))

        return frozenset(p for p in self.scores if len(p) > 1 and parts(p) != 2) if self.bpe else frozenset()

    def normal(self, text: str) -> str:
        text = text.replace(" ", MARK)
        return MARK + text if self.prefix and text else text


@functools.lru_cache(maxsize=2)
def load(path: str = MODEL) -> Model:
    return Model(path)


def _ids_of(model_ids: dict, byte_ids: dict, unknown: int, pieces: list[str]) -> list[int]:
    out = []
    for p in pieces:
        i = model_ids.get(p)
        if i is not None:
            out.append(i)
        elif byte_ids:
            out += [byte_ids[b] for b in p.encode()]
        else:
            out.append(unknown)
    return out


def merge_long(word: str, scores: dict[str, float]) -> list[str]:
    """BPE pieces of one word by a heap of merges."""
    piece, left, right = list(word), list(range(-1, len(word) - 1)), list(range(1, len(word) + 1))
    heap: list = []

    def offer(i: int) -> None:
        j = right[i]
        if j < len(piece) and (s := scores.get(piece[i] + piece[j])) is not None:
            heapq.heappush(heap, (-s, i, len(piece[i]) + len(piece[j])))

    for i in range(len(piece) - 1):
        offer(i)
    while heap:
        _, i, size = heapq.heappop(heap)
        j = right[i]
        if not piece[i] or j >= len(piece) or len(piece[i]) + len(piece[j]) != size or (piece[i] + piece[j]) not in scores:
            continue
        piece[i] += piece[j]
        piece[j] = ""
        right[i] = right[j]
        if right[j] < len(piece):
            left[right[j]] = i
        offer(i)
        if left[i] >= 0:
            offer(left[i])
    return [p for p in piece if p]


def viterbi_long(word: str, scores: dict[str, float], longest: int, unknown: float) -> list[str]:
    """Unigram pieces of one word: what `viterbi_fold` says, for words of any length."""
    best, start = [0.0], [0]
    for e in range(1, len(word) + 1):
        top, at = best[e - 1] + unknown, e - 1
        for s in range(e - 1, max(0, e - longest) - 1, -1):
            score = scores.get(word[s:e])
            if score is not None and best[s] + score >= top:
                top, at = best[s] + score, s
        best.append(top)
        start.append(at)
    out, e = [], len(word)
    while e:
        out.append(word[start[e] : e])
        e = start[e]
    return out[::-1]


def cut_at(word: str, mask: int) -> list[str]:
    """Pieces between the cuts of a mask; bit i is a cut before character i."""
    at = [i for i in range(len(word) + 1) if mask >> i & 1]
    return [word[a:b] for a, b in zip(at, at[1:], strict=False)]


# ---- the lattice -------------------------------------------------------------------------------------


def edges(words: DataFrame, pieces: DataFrame, longest: int, shortest: int, key: str | None = None) -> DataFrame:
    """(key, word, edges, odd): of each word in `words` the substrings that are pieces (piece, score, odd), as array<struct<score, neg, ends, span>>:
    minus the start, the bits of both ends, and the bits from start to end; odd: one of them is. key: a column that each word has one value
    of and that words are partitioned by already, so that no exchange is needed."""
    own = [key] if key else []
    size = F.char_length("word")
    starts = words.where(size >= shortest).select(*own, "word", F.explode(F.sequence(F.lit(0), size - shortest)).alias("s"))
    spans = starts.select(*own, "word", "s", F.explode(F.sequence(F.lit(shortest), F.least(F.lit(longest), size - F.col("s")))).alias("k"))
    rows = spans.select(*own, "word", "s", "k", F.substr("word", F.col("s") + 1, F.col("k")).alias("piece")).join(F.broadcast(pieces), "piece")
    bit = lambda i: F.expr(f"shiftleft(1L, {i})")
    edge = F.struct("score", (-F.col("s")).alias("neg"), bit("s").bitwiseOR(bit("s + k")).alias("ends"), (bit("s + k + 1") - bit("s")).alias("span"))
    odd = F.max("odd") if "odd" in pieces.columns else F.lit(False)
    # The hash in front makes the sort by word a sort by numbers.
    return rows.groupBy(*own, F.xxhash64("word"), "word").agg(F.collect_list(edge).alias("edges"), odd.alias("odd")).select(*own, "word", "edges", "odd")


def pair_fold() -> Column:
    """Mask of cuts by BPE merges, pair by pair: from all cuts, the best edge that covers exactly two pieces loses its inner cut, until none is left."""
    # Edges sort by score, then from right to left, so the last one that applies is the best.
    return F.expr(
        """aggregate(sequence(1, greatest(char_length(word) - 1, 1)), named_struct('m', shiftleft(1L, char_length(word) + 1) - 1L, 'es', sort_array(edges)),
          (s, i) -> transform(array(filter(s.es, x -> (s.m & x.ends) = x.ends)), es ->
            named_struct('m', s.m - coalesce(get(transform(slice(filter(es, x -> bit_count(s.m & x.span) = 3), -1, 1), x -> (s.m & x.span) - x.ends), 0), 0L), 'es', es))[0],
          s -> s.m)"""
    )


def merge_fold() -> Column:
    """Mask of cuts by BPE merges in one pass over the edges, best score first and of equal ones from left to right. Exact for words without an odd piece."""
    return F.expr("aggregate(sort_array(edges, false), shiftleft(1L, char_length(word) + 1) - 1L, (m, x) -> if((m & x.ends) = x.ends, (m & ~x.span) | x.ends, m))")


def viterbi_fold(unknown: float) -> Column:
    """Mask of cuts with the best sum of scores; a character under no one-character edge costs `unknown`. Ties take the longer last piece."""
    forward = f"""aggregate(sequence(1, char_length(word)), array(struct(0D AS sum, 0 AS back)), (st, e) -> concat(st, array(
        array_max(concat(
          transform(filter(edges, x -> (x.ends & shiftleft(1L, e)) <> 0 AND x.span = shiftleft(1L, e + 1) - shiftleft(1L, -x.neg)),
            x -> struct(st[-x.neg].sum + cast(x.score AS double) AS sum, x.neg AS back)),
          array(struct(st[e - 1].sum + {unknown}D AS sum, 1 - e AS back)))))))"""
    back = """aggregate(sequence(1, char_length(word)), struct(shiftleft(1L, char_length(word)) AS m, char_length(word) AS at),
        (b, i) -> if(b.at = 0, b, struct(b.m | shiftleft(1L, -path[b.at].back) AS m, -path[b.at].back AS at)), b -> b.m)"""
    return F.expr(f"transform(array({forward}), path -> {back})[0]")


def word_masks(words: DataFrame, model: Model, key: str | None = None) -> DataFrame:
    """(key, word, mask) of distinct words up to LONGEST characters; words without an edge are left out, as each character stands alone. Keeps the partitioning by key."""
    spark = words.sparkSession
    if len(model.ids) > 1 << 20:
        raise ValueError("the piece table is too large to broadcast")
    rows = [(p, s, p in model.odd) for p, s in model.scores.items()]
    table = spark.createDataFrame(pd.DataFrame(rows, columns=["piece", "score", "odd"]), "piece string, score float, odd boolean")
    fold = F.when(F.col("odd"), pair_fold()).otherwise(merge_fold()) if model.bpe else viterbi_fold(min(model.scores.values()) - 10)
    return edges(words, table, model.longest, 2 if model.bpe else 1, key).select(*([key] if key else []), "word", fold.alias("mask"))


# ---- words of batches -----------------------------------------------------------------------------------

_SENT = "key long, kind int, batch long, bucket long, n int, pack binary, places binary, ids array<{0}>, sizes array<int>, checks array<long>"
WORDS, TEXTS = 0, 1


def _squeeze(x: np.ndarray) -> bytes:
    """uint32 values, byte planes apart."""
    return zstandard.compress(np.ascontiguousarray(np.ascontiguousarray(x, "<u4").view(np.uint8).reshape(-1, 4).T).tobytes(), 3)


def _loosen(data: bytes) -> np.ndarray:
    planes = np.frombuffer(zstandard.decompress(data), np.uint8).reshape(4, -1)
    return np.ascontiguousarray(planes.T).view("<u4").ravel()


def _pack_words(words: list[bytes]) -> bytes:
    sizes = np.array([len(r) for r in words], "<u4").tobytes()
    return zstandard.compress(sizes + b"".join(words), 3)


def _unpack_words(pack: bytes, n: int) -> list[bytes]:
    raw = zstandard.decompress(pack)
    ends = 4 * n + np.cumsum(np.frombuffer(raw[: 4 * n], "<u4").astype(np.int64))
    starts = np.r_[4 * n, ends[:-1]] if n else ends
    return [raw[a:b] for a, b in zip(starts.tolist(), ends.tolist(), strict=True)]


def _name(word: bytes) -> str:
    return word.decode().replace(" ", MARK)


def _distinct_words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(starts, ends, number of the distinct word, an occurrence of each distinct word, its hash) of texts with spaces as marks. A word
    starts where a text does, at the first space or line feed of a run, and after line feeds."""
    pieces = []
    row, rows = 0, len(offsets) - 1
    while row < rows:
        end = max(row + 1, int(np.searchsorted(offsets, offsets[row] + (1 << 19), "right")) - 1)
        d, at = data[offsets[row] : offsets[end]], offsets[row : end + 1] - offsets[row]
        if len(d):
            before = np.r_[np.uint8(0), d[:-1]]
            first = ((d == 32) & (before != 32)) | ((d == 10) != (before == 10))
            first[at[:-1][np.diff(at) > 0]] = True
            starts = np.flatnonzero(first)
            ends = np.r_[starts[1:], len(d)]
            pieces.append(((starts + offsets[row]).astype(np.int32), (ends + offsets[row]).astype(np.int32), spans_hash(_VALUE[d], starts, ends)))
        row = end
    if not pieces:
        none = np.zeros(0, np.int64)
        return none, none, none, none, none.astype(np.uint64)
    starts, ends = (np.concatenate([p[k] for p in pieces]) for k in (0, 1))
    counts = [len(p[0]) for p in pieces]
    hashes = np.concatenate([p[2] for p in pieces])
    del pieces
    word = pd.factorize(hashes)[0].astype(np.int32)
    reps = np.empty(int(word.max()) + 1, np.int32)
    reps[word[::-1]] = np.arange(len(word) - 1, -1, -1, dtype=np.int32)
    size, lead = ends - starts, reps[word]
    same, at = bool((size == size[lead]).all()), 0
    for n in counts if same else []:
        own = slice(at, at + n)
        a, z = int(starts[at]), int(ends[at + n - 1])
        same = same and bool((data[a:z] == data[np.arange(a, z) + np.repeat(starts[lead[own]].astype(np.int64) - starts[own], size[own])]).all())
        at += n
    if not same:  # two words share a hash
        text, known = data.tobytes(), {}
        word = np.fromiter((known.setdefault(text[a:b], len(known)) for a, b in zip(starts.tolist(), ends.tolist(), strict=True)), np.int64, len(starts))
        _, reps = np.unique(word, return_index=True)
    return starts, ends, word, reps, hashes[reps]


def send(docs: DataFrame, key: str, text: str, model: Model, buckets: int) -> DataFrame:
    """Rows of two kinds. WORDS: of one batch the distinct words of one bucket, sorted (key: bucket). TEXTS: the texts of one batch as numbers of
    words, frequent ones small (key: batch), with places: where among the batch's words, by bucket and then sorted, each number
    stands; and for each text its row's key, its number of words and its hash."""
    kind = dict(docs.select(key).dtypes)[key]
    prefix = model.prefix

    def run(batches):
        release()
        for batch in batches:
            column, row = batch.column(1), 0
            while row < batch.num_rows:
                raws, checks, size, first = [], [], 0, row
                while row < batch.num_rows and (row == first or size < BATCH_BYTES):
                    raw = (column[row].as_py() or "").encode()
                    checks.append(xxhash.xxh64_intdigest(raw, 42))
                    raw = raw.replace(_MARK, b" ")
                    raws.append(b" " + raw if prefix and raw else raw)
                    size += len(raw)
                    row += 1
                data = b"".join(raws)
                offsets = np.cumsum([0, *map(len, raws)])
                del raws
                number = int(np.int64(np.uint64(xxhash.xxh3_64_intdigest(offsets.tobytes() + data))))
                starts, ends, word, reps, hashes = _distinct_words(np.frombuffer(data, np.uint8), offsets)
                sizes = np.diff(np.searchsorted(starts, offsets))
                names = [data[a:b] for a, b in zip(starts[reps].tolist(), ends[reps].tolist(), strict=True)]
                # Frequent words get small numbers.
                rank = np.empty(len(names), np.int32)
                rank[np.argsort(-np.bincount(word, minlength=len(names)), kind="stable")] = np.arange(len(names))
                bucket = (hashes % np.uint64(buckets)).astype(np.int64)
                order = np.argsort(bucket, kind="stable")
                edge = np.flatnonzero(np.r_[True, np.diff(bucket[order]) != 0]) if len(order) else np.zeros(0, int)
                rows, places = [], np.empty(len(names), np.int64)
                for a, b in zip(edge.tolist(), [*edge[1:].tolist(), len(order)], strict=True):
                    own = sorted(order[a:b].tolist(), key=names.__getitem__)
                    places[rank[own]] = np.arange(a, b)
                    rows.append((int(bucket[own[0]]), WORDS, number, int(bucket[own[0]]), len(own), _pack_words([names[i] for i in own]), None, None, None, None))
                ids = pa.ListArray.from_arrays(pa.array([0] * (len(rows) + 1) + [row - first], pa.int32()), batch.column(0).slice(first, row - first))
                rows.append((number, TEXTS, number, -1, row - first, _squeeze(rank[word]), _squeeze(places), None, sizes, np.array(checks, np.uint64).view(np.int64)))
                types = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.binary(), pa.binary(), None, pa.list_(pa.int32()), pa.list_(pa.int64())]
                columns = [ids if t is None else pa.array([r[i] for r in rows], t) for i, t in enumerate(types)]
                yield pa.RecordBatch.from_arrays(columns, [x.split()[0] for x in _SENT.split(", ")])
                del data, starts, ends, word, reps, hashes, sizes, names, rank, bucket, order, rows, places, columns, ids
                release()

    return docs.select(key, text).mapInArrow(run, _SENT.format(kind))


def encode(docs: DataFrame, key: str, text: str, path: str = MODEL, back: str | None = None) -> DataFrame:
    """(key, n_ids, ids, check): ids as little-endian numbers, 2 bytes each for models of up to 65,536 pieces, else 4; check is the XXH64 of the text, seed 42.
    back: name of one more column, the texts that `decode` makes of the ids; they are made where the ids are, so that a task has one Python worker and not two."""
    model = load(path)
    kind = dict(docs.select(key).dtypes)[key]
    spark = docs.sparkSession
    total = docs.agg(F.sum(F.octet_length(text))).first()[0] or 0
    buckets = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-total // BUCKET_BYTES))
    # Groups are bounded by BUCKET_BYTES of text each; a task takes several where there are more groups than Spark can have tasks.
    tasks = min(buckets, TASKS)
    # One exchange feeds the three steps below: each reads all its columns and sorts out the kinds itself.
    sent = send(docs.select(F.col(key).alias("_id"), F.col(text).alias("text")), "_id", "text", model, buckets).repartition(tasks, "key")

    def distinct(pdf: pd.DataFrame) -> pd.DataFrame:
        release()
        found: set[bytes] = set()
        for pack, n, kind in zip(pdf["pack"], pdf["n"], pdf["kind"], strict=True):
            if kind == WORDS:
                found.update(_unpack_words(pack, n))
        words = [w for w in map(_name, found) if 1 < len(w) <= LONGEST]
        return pd.DataFrame({"key": np.full(len(words), pdf["key"].iloc[0], np.int64), "word": pd.Series(words, dtype=object)})

    # A word's bucket is its key, so one exchange by key serves the lattice and its return to the batches.
    vocabulary = sent.groupBy("key").applyInPandas(distinct, "key long, word string").repartition(tasks, "key")
    masks = word_masks(vocabulary, model, "key")
    longest, lowest = model.longest, min(model.scores.values()) - 10
    ids, byte_ids, unknown, scores, bpe, stored = model.ids, model.bytes, model.unknown, model.scores, model.bpe, model.stored
    width = np.dtype(stored).itemsize
    plain, prefix = model.plain, model.prefix

    def resolve(sent: pd.DataFrame, cuts: pd.DataFrame) -> pd.DataFrame:
        release()
        mask = dict(zip(cuts["word"].tolist(), cuts["mask"].tolist(), strict=True)) if len(cuts) else {}
        sent = sent[sent["kind"] == WORDS]
        number: dict[bytes, int] = {}
        packs = []
        for pack, n in zip(sent["pack"], sent["n"], strict=True):
            packs.append(np.fromiter((number.setdefault(w, len(number)) for w in _unpack_words(pack, n)), np.int64, n))

        def pieces_of(w: str) -> list[str]:
            m = mask.get(w)
            if m is not None:
                return cut_at(w, m)
            if len(w) <= LONGEST:
                return list(w)
            return merge_long(w, scores) if bpe else viterbi_long(w, scores, longest, lowest)

        flat, size = [], []
        for w in number:
            got = _ids_of(ids, byte_ids, unknown, pieces_of(_name(w)))
            flat += got
            size.append(len(got))
        flat, size = np.array(flat, np.uint32), np.array(size, np.int64)
        start = np.cumsum(size) - size
        out = []
        for words, batch, bucket in zip(packs, sent["batch"], sent["bucket"], strict=True):
            each = size[words]
            ends = np.cumsum(each)
            values = flat[np.arange(int(ends[-1]) if len(ends) else 0) + np.repeat(start[words] - (ends - each), each)]
            out.append((batch, bucket, _squeeze(each.astype(np.uint32)), _squeeze(values)))
        return pd.DataFrame(out, columns=["key", "bucket", "counts", "values"])

    cuts = sent.groupBy("key").cogroup(masks.groupBy("key")).applyInPandas(resolve, "key long, bucket long, counts binary, values binary").repartition(tasks, "key")

    def assemble(own: pd.DataFrame, packs: pd.DataFrame) -> pd.DataFrame:
        release()
        own, packs = own[own["kind"] == TEXTS], packs.drop_duplicates("bucket").sort_values("bucket")
        size = np.concatenate([np.zeros(0, np.int64), *[_loosen(x).astype(np.int64) for x in packs["counts"]]])
        values = np.concatenate([np.zeros(0, stored), *[_loosen(x).astype(stored) for x in packs["values"]]])
        start = np.cumsum(size) - size
        keys, out, counts, checks = [], [], [], []
        for pack, places, ids, sizes, hashes in zip(own["pack"], own["places"], own["ids"], own["sizes"], own["checks"], strict=True):
            word = _loosen(places)[_loosen(pack)]
            ends = np.r_[0, np.cumsum(size[word])]
            cuts = ends[np.cumsum(np.r_[0, sizes])] * width
            parts = []
            for a in range(0, len(word), GATHER):
                own_words = word[a : a + GATHER]
                at = np.repeat((start[own_words] - ends[a : a + len(own_words)]).astype(np.int32), size[own_words])
                at += np.arange(ends[a], ends[a] + len(at), dtype=np.int32)
                parts.append(values[at])
            data = np.concatenate([np.zeros(0, stored), *parts]).tobytes()
            out += [data[a:b] for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True)]
            keys += list(ids)
            counts.append(np.diff(cuts) // width)
            checks.append(hashes)
        del size, values, start
        columns = {"_id": pd.Series(keys, dtype=object), "n_ids": np.concatenate([np.zeros(0, np.int64), *counts]), "ids": out, "check": np.concatenate([np.zeros(0, np.int64), *checks])}
        if back:
            texts = [x for i in range(0, len(out), ROWS) for x in _texts(out[i : i + ROWS], plain, stored, prefix).to_pylist()]
            columns["_text"] = pd.Series(texts, dtype=object)
        return pd.DataFrame(columns)

    rows = sent.groupBy("key").cogroup(cuts.groupBy("key")).applyInPandas(assemble, f"_id {kind}, n_ids long, ids binary, check long" + (", _text string" if back else ""))
    # Groups are small, so that they fit in memory; a task takes several of them, so that files are not.
    rows = rows.coalesce(max(1, tasks // GROUPS_PER_TASK)).withColumnRenamed("_id", key)
    return rows.withColumnRenamed("_text", back) if back else rows


def _texts(ids: list[bytes | None], plain: list[bytes], stored: str, prefix: bool) -> pa.Array:
    """Texts of stored ids: the bytes of all pieces gathered at once."""
    flat = np.frombuffer(b"".join(i or b"" for i in ids), stored)
    rows = np.cumsum([0, *(len(i or b"") // np.dtype(stored).itemsize for i in ids)])
    table, sizes = np.frombuffer(b"".join(plain), np.uint8), np.array([len(p) for p in plain], np.int32)
    begins = np.cumsum(sizes, dtype=np.int32) - sizes
    size = sizes[flat]
    skip = np.zeros(len(flat), bool)
    if prefix:  # the space in front of a text goes
        first = rows[:-1][np.diff(rows) > 0]
        skip[first] = (size[first] > 0) & (table[np.minimum(begins[flat[first]], len(table) - 1)] == 32)
        size -= skip
    offsets = np.r_[0, np.cumsum(size, dtype=np.int64)][rows]
    parts = []
    for a in range(0, len(flat), GATHER):
        own, each = flat[a : a + GATHER], size[a : a + GATHER]
        ends = np.cumsum(each, dtype=np.int32)
        at = np.repeat(begins[own] + skip[a : a + GATHER] - (ends - each), each)
        at += np.arange(len(at), dtype=np.int32)
        parts.append(table[at])
    data = np.concatenate([np.zeros(0, np.uint8), *parts])
    if offsets[-1] < 1 << 31:
        out = pa.StringArray.from_buffers(len(ids), pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(data))
        try:
            out.validate(full=True)
            return out
        except pa.ArrowInvalid:  # bytes of characters that were cut
            pass
    raw = data.tobytes()
    return pa.array([raw[a:b].decode("utf-8", "replace") for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)], pa.string())


def decode(rows: DataFrame, key: str, ids: str, path: str = MODEL, keep: tuple[str, ...] = ()) -> DataFrame:
    """(key, *keep, text): texts of ids as `encode` stores them; bytes that are not UTF-8 become replacement characters."""
    model = load(path)
    plain, prefix, stored = model.plain, model.prefix, model.stored
    types = dict(rows.dtypes)

    def run(batches):
        for batch in batches:
            for i in range(0, batch.num_rows, ROWS):
                part = batch.slice(i, ROWS)
                yield pa.RecordBatch.from_arrays([part.column(0), *part.columns[2:], _texts(part.column(1).to_pylist(), plain, stored, prefix)], [key, *keep, "text"])
            release()

    return rows.select(key, ids, *keep).mapInArrow(run, ", ".join([f"`{key}` {types[key]}", *[f"`{c}` {types[c]}" for c in keep], "text string"]))


def op6_piece_lattice(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = encode(documents(spark, sf_dir), "doc_id", "text", back="text")
    return rows.select("doc_id", "n_ids", F.sha2("ids", 256).alias("ids_sha256"), (F.xxhash64("text") == F.col("check")).alias("round_trip"))
