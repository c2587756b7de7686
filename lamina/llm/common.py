"""What several operators share: cutting lineage, gapless numbering, components of a graph."""

from __future__ import annotations

import tempfile
import uuid

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def folder(spark: SparkSession) -> str:
    """The shared folder that spark.checkpoint.dir names; only a local session without one gets a temporary folder."""
    context = spark.sparkContext
    if not context._jsc.sc().getCheckpointDir().isDefined():
        name = context.getConf().get("spark.checkpoint.dir", None)
        if name is None:
            if not (context.master == "local" or context.master.startswith("local[")):
                raise ValueError("spark.checkpoint.dir must name a shared folder on a cluster")
            name = tempfile.mkdtemp(prefix="lamina-checkpoint-")
        context.setCheckpointDir(name)
    return context._jsc.sc().getCheckpointDir().get()


def cut(df: DataFrame) -> DataFrame:
    """Write df as Parquet to the shared checkpoint folder and read it back, so that later stages and lost
    executors start from there and read only the columns they need."""
    path = f"{folder(df.sparkSession)}/lamina-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._lamina_path = path
    return out


def discard(df: DataFrame | None) -> None:
    """Delete the files of a `cut` that later ones have taken the place of."""
    name = getattr(df, "_lamina_path", None)
    if name is not None:
        spark = df.sparkSession
        path = spark._jvm.org.apache.hadoop.fs.Path(name)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def kept(df: DataFrame) -> DataFrame:
    """df stored on the executors' disks while several jobs read it; what a lost executor held is computed again."""
    return df.persist(StorageLevel.DISK_ONLY)


def small(df: DataFrame, most_rows: int = 500_000) -> DataFrame:
    """df (stored, a few numbers a row), marked for broadcast if it has at most most_rows rows; a larger one is joined by shuffle."""
    return F.broadcast(df) if df.count() <= most_rows else df


def dealt(df: DataFrame, total: int, *keys: str, most: int = 64 << 20) -> DataFrame:
    """df, whose texts have `total` bytes, in partitions by the keys of `most` bytes where the session's own number of partitions would make larger ones."""
    n = -(-total // most)
    return df.repartition(n, *keys) if n > int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")) else df


def release() -> None:
    """Give freed memory back to the system: idle Python workers stay resident beside the executor."""
    import ctypes

    import pyarrow as pa

    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


SPREAD = 1 << 28


def spread(key: Column) -> Column:
    """A long in [0, SPREAD) from the key's text form, the same in any SQL engine with md5; 0 for null."""
    return F.coalesce(F.conv(F.substring(F.md5(key.cast("string").cast("binary")), 1, 7), 16, 10).cast("long"), F.lit(0).cast("long"))


def gapless(df: DataFrame, group: list[str], order: list[str], by: Column, name: str, parts: int | None = None) -> DataFrame:
    """Add `name`: 0, 1, 2, ... without gaps inside each group, in the order (by, then `order`). by: a long in [0, SPREAD).
    Each group is numbered in `parts` pieces, ranges of `by`, whose offsets come from a count per piece, so a group of any size never
    meets in one task; the order is the same for any number of pieces (256 at least, more with spark.sql.shuffle.partitions). Group
    columns hold no nulls; names that begin with _lamina are taken."""
    parts = parts or max(256, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    piece = df.withColumn("_lamina_by", by).withColumn("_lamina_piece", F.floor(F.col("_lamina_by") * parts / SPREAD).cast("int"))
    counts = piece.groupBy(*group, "_lamina_piece").agg(F.count(F.lit(1)).alias("_lamina_n"))
    before = Window.partitionBy(*group).orderBy("_lamina_piece").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(*group, "_lamina_piece", F.coalesce(F.sum("_lamina_n").over(before), F.lit(0)).alias("_lamina_offset"))
    inside = Window.partitionBy(*group, "_lamina_piece").orderBy("_lamina_by", *order)
    return (
        piece.withColumn("_lamina_at", F.row_number().over(inside))
        .join(offsets, [*group, "_lamina_piece"])
        .withColumn(name, (F.col("_lamina_offset") + F.col("_lamina_at") - 1).cast("long"))
        .drop("_lamina_by", "_lamina_piece", "_lamina_at", "_lamina_offset")
    )


def salted_join(rows: DataFrame, named: DataFrame, by: str, copies: str, salt: Column) -> DataFrame:
    """rows (left, inner) joined with named (one row for each value of the long `by`, with the number of rows that hold it in `copies`).
    A value that holds over a thousandth of the rows is hot: under 1,000 can be, so they are broadcast, and each is dealt to several tasks."""
    most = max(1000, (named.agg(F.sum(copies)).first()[0] or 0) // 1000)
    salts = F.when(F.col(copies) > most, F.ceil(F.col(copies) / most)).otherwise(1).cast("int")
    hot = named.where(F.col(copies) > most).select(by, salts.alias("_lamina_salts"))
    left = rows.join(F.broadcast(hot), by, "left").withColumn("_lamina_salt", F.coalesce(F.pmod(salt, F.col("_lamina_salts")), F.lit(0)).cast("int")).drop("_lamina_salts")
    right = named.withColumn("_lamina_salt", F.explode(F.sequence(F.lit(0), salts - 1))).drop(copies)
    return left.join(right, [by, "_lamina_salt"]).drop("_lamina_salt")


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
    return both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    moved = edges.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.union(least.select("u", F.col("m").alias("v"))).distinct()


def components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(node, root) for every node of the undirected `edges` (u, v: long): root is the smallest node
    reachable. Alternates large-star and small-star joins until nothing changes; each round is
    written once and the one before deleted, only its count and checksum come to the driver."""
    e = cut(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    seen = None
    for _ in range(most_rounds):
        state = e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == seen or not state[0]:
            break
        seen, old = state, e
        e = cut(_small_star(_large_star(e)))
        discard(old)
    else:
        raise RuntimeError("components did not settle")
    return e.select(F.col("u").alias("node"), F.col("v").alias("root")).union(e.select("v", "v").distinct())
