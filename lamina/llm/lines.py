"""Line dedup over content-defined chunks of lines.

A text is cut into lines at \\n. A rolling hash over the hashes of the last WINDOW lines ends a chunk
wherever it is 0 modulo DIVISOR, so chunk borders follow content and not position. Chunks of several lines meet by
hash over the whole table; every chunk that equals the earliest of its hash byte for byte
(smallest doc_id, then first line) goes, the earliest stays. A chunk whose hash meets but whose bytes differ stays.

Defined results: a null text stays null and has no lines; an empty text is one empty line; a null doc_id
comes last; rows that share a doc_id are ordered by text hash, and exact repeats of such a row keep the
same lines; an empty table gives no rows; other columns are kept by `remove_chunks`, whose _n_lines and _n_removed take the place of
input columns of those names; names that begin with _lamina are taken.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, documents

WINDOW, DIVISOR, MIN_LINES = 3, 3, 2
HOT_COPIES = 1000
_BASE, _MOD = 65599, 2147483647


def _line_hash(line: Column) -> Column:
    return F.conv(F.substring(F.md5(line.cast("binary")), 1, 7), 16, 10).cast("long")


def chunked(docs: DataFrame, key: str, text: str, window: int = WINDOW, divisor: int = DIVISOR) -> DataFrame:
    """(doc, t, lines, chunks): chunks is array<struct<first, n>>, first counting lines from 1; t tells texts of one doc apart."""
    rows = docs.select(F.col(key).alias("doc"), F.xxhash64(text).alias("t"), F.split(text, "\n").alias("lines"))
    rows = rows.withColumn("h", F.transform("lines", _line_hash))

    def ends_chunk(i: Column) -> Column:
        roll = F.lit(0).cast("long")
        for k in reversed(range(window)):
            roll = (roll * _BASE + F.get("h", (i - k - 1).cast("int"))) % _MOD
        return (i == F.size("lines")) | ((i >= window) & (roll % divisor == 0))

    rows = rows.withColumn("ends", F.filter(F.sequence(F.lit(1), F.greatest(F.size("lines"), F.lit(1))), ends_chunk))
    before = F.concat(F.array(F.lit(0)), F.slice("ends", 1, F.greatest(F.size("ends") - 1, F.lit(0))))
    pieces = F.transform(F.arrays_zip(before.alias("a"), F.col("ends").alias("b")), lambda x: F.struct((x["a"] + 1).alias("first"), (x["b"] - x["a"]).alias("n")))
    return rows.select("doc", "t", "lines", pieces.alias("chunks"))


def repeated_chunks(docs: DataFrame, key: str, text: str, window: int = WINDOW, divisor: int = DIVISOR, min_lines: int = MIN_LINES) -> DataFrame:
    """(doc, t, first, n): chunks of at least min_lines lines that equal an earlier chunk."""
    # The bodies are cut out inside the row, so that no exploded row carries its whole text.
    cut_out = lambda c: F.struct(c["first"].alias("first"), c["n"].alias("n"), F.array_join(F.slice("lines", c["first"], c["n"]), "\n").alias("body"))
    pieces = F.transform(F.filter("chunks", lambda c: c["n"] >= min_lines), cut_out)
    rows = chunked(docs.where(F.col(text).isNotNull()), key, text, window, divisor).select("doc", "t", F.explode(pieces).alias("c"))
    rows = rows.select("doc", "t", F.col("c.first").alias("first"), F.coalesce("c.n", F.lit(0)).alias("n"), F.coalesce("c.body", F.lit("")).alias("body")).withColumn("hash", F.xxhash64("body"))
    place = F.struct(F.col("doc").isNull().alias("last"), "doc", "t", "first")
    groups = cut(rows.groupBy("hash").agg(F.min(place).alias("place"), F.count(F.lit(1)).alias("copies")).where("copies > 1"))
    # A hash with over a thousandth of the copies is hot: fewer than 1,000 can be, so they are broadcast, and each is dealt to several tasks.
    most = max(HOT_COPIES, (groups.agg(F.sum("copies")).first()[0] or 0) // 1000)
    salts = F.when(F.col("copies") > most, F.ceil(F.col("copies") / most)).otherwise(1).cast("int")
    hot = groups.where(F.col("copies") > most).select("hash", salts.alias("salts"))
    salted = rows.join(F.broadcast(hot), "hash", "left").withColumn("salt", F.coalesce(F.pmod(F.xxhash64("doc", "t", "first"), F.col("salts")), F.lit(0)).cast("int")).drop("salts")
    spread = F.explode(F.sequence(F.lit(0), salts - 1)).alias("salt")
    # A sort-merge join at every size: copies grow with the table.
    met = salted.join(groups.select("hash", "place", "copies", spread).hint("merge"), ["hash", "salt"])
    # Both branches read the same columns and compare by order, which does not become a key of the join, so that chunk bodies are shuffled once.
    least = met.where(place <= F.col("place")).groupBy("hash").agg(F.min("body").alias("kept"), F.min("n").alias("kept_n"), F.min("copies").alias("copies")).select("hash", "kept", "kept_n", spread)
    return met.where(place > F.col("place")).join(least, ["hash", "salt"]).where("body <= kept and body >= kept and n <= kept_n and n >= kept_n").select("doc", "t", "first", "n")


def remove_chunks(docs: DataFrame, key: str, text: str, window: int = WINDOW, divisor: int = DIVISOR, min_lines: int = MIN_LINES) -> DataFrame:
    """docs with the lines of repeated chunks taken out of `text`, and _n_lines and _n_removed."""
    gone = repeated_chunks(docs, key, text, window, divisor, min_lines).groupBy(F.col("doc").alias("_lamina_doc"), F.col("t").alias("_lamina_t")).agg(F.array_sort(F.collect_set(F.struct("first", "n"))).alias("_lamina_gone"))
    joined = docs.join(gone, F.col(key).eqNullSafe(F.col("_lamina_doc")) & (F.xxhash64(text) == F.col("_lamina_t")), "left").drop("_lamina_doc", "_lamina_t")
    lines = F.split(text, "\n")
    size = F.size(lines)
    # What stays: from the end of each gone chunk to the start of the next.
    starts = F.concat(F.array(F.lit(1)), F.transform("_lamina_gone", lambda g: g["first"] + g["n"]))
    ends = F.concat(F.transform("_lamina_gone", lambda g: g["first"]), F.array(size + 1))
    # The lines are bound once for all slices, as the elements of a one-element array.
    kept = F.transform(F.array(lines), lambda ls: F.array_join(F.flatten(F.transform(F.arrays_zip(starts.alias("a"), ends.alias("b")), lambda x: F.slice(ls, x["a"], x["b"] - x["a"]))), "\n"))[0]
    removed = F.coalesce(F.aggregate("_lamina_gone", F.lit(0), lambda s, g: s + g["n"]), F.lit(0))
    return (
        joined.withColumn("_n_lines", F.when(F.col(text).isNull(), 0).otherwise(size).cast("long"))
        .withColumn("_n_removed", removed.cast("long"))
        .withColumn(text, F.when(F.col("_lamina_gone").isNull(), F.col(text)).otherwise(kept))
        .drop("_lamina_gone")
    )


def op2_line_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = remove_chunks(documents(spark, sf_dir).select("doc_id", "text"), "doc_id", "text")
    return rows.select("doc_id", F.col("_n_lines").alias("n_lines"), F.col("_n_removed").alias("n_removed"), F.octet_length(F.coalesce("text", F.lit(""))).cast("long").alias("kept_bytes"), F.md5(F.coalesce("text", F.lit("")).cast("binary")).alias("kept_md5"))


# Repeated rows cannot be told apart here, so this needs unique doc_ids, as in the test tables.
OP2_SQL = f"""
WITH l AS (
  SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS i
  FROM documents WHERE text IS NOT NULL),
h AS (SELECT *, ('0x' || substr(md5(line), 1, 7))::BIGINT AS h FROM l),
r AS (
  SELECT *, lag(h, 1) OVER w AS h1, lag(h, 2) OVER w AS h2, lead(i) OVER w AS nxt FROM h WINDOW w AS (PARTITION BY doc_id ORDER BY i)),
e AS (
  SELECT doc_id, line, i,
    CASE WHEN nxt IS NULL OR (h2 IS NOT NULL AND ((((h2 % {_MOD}) * {_BASE} + h1) % {_MOD} * {_BASE} + h) % {_MOD}) % {DIVISOR} = 0) THEN 1 ELSE 0 END AS ends
  FROM r),
c AS (SELECT *, coalesce(sum(ends) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS chunk FROM e),
g AS (SELECT doc_id, chunk, min(i) AS first, count(*) AS n, string_agg(line, chr(10) ORDER BY i) AS body FROM c GROUP BY ALL),
k AS (SELECT *, n >= {MIN_LINES} AND row_number() OVER (PARTITION BY n >= {MIN_LINES}, body ORDER BY doc_id, first) > 1 AS gone FROM g),
t AS (
  SELECT doc_id, sum(n)::BIGINT AS n_lines, coalesce(sum(n) FILTER (WHERE gone), 0)::BIGINT AS n_removed,
    coalesce(string_agg(body, chr(10) ORDER BY first) FILTER (WHERE NOT gone), '') AS kept
  FROM k GROUP BY doc_id)
SELECT d.doc_id, coalesce(t.n_lines, 0) AS n_lines, coalesce(t.n_removed, 0) AS n_removed,
  strlen(coalesce(t.kept, ''))::BIGINT AS kept_bytes, md5(coalesce(t.kept, '')) AS kept_md5
FROM documents d LEFT JOIN t USING (doc_id)
"""
