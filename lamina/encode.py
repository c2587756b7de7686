"""Encoders: text to vector, as a pluggable function in Arrow batches."""

from __future__ import annotations

import logging
import uuid
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .functions import text

log = logging.getLogger(__name__)

Encode = Callable[[list[str]], list[list[float]]]


#: Encode functions that this process has loaded, by encoder; None where loading failed.
_LOADED: dict[str, Encode | None] = {}


def _loaded(name: str, load: Callable[[], Encode] | None) -> Encode | None:
    if name not in _LOADED:
        try:
            _LOADED[name] = load() if load is not None else None
        except Exception:
            log.warning("the encoder can't be loaded; search goes by keywords", exc_info=True)
            _LOADED[name] = None
    return _LOADED[name]


class Encoder:
    """load() gives the encode function; it is called once in each process. Without load, or where it fails, there are no vectors and search goes by keywords."""

    def __init__(self, load: Callable[[], Encode] | None = None):
        self.load, self.name = load, uuid.uuid4().hex

    @property
    def ready(self) -> bool:
        """Whether this process has an encode function."""
        return _loaded(self.name, self.load) is not None

    @property
    def mode(self) -> str:
        return "transformers" if self.ready else "fallback"

    def one(self, query: str) -> list[float]:
        run = _loaded(self.name, self.load)
        return [] if run is None else list(run([query])[0])

    def column(self, source):
        if self.load is None:
            return F.array().cast("array<float>")
        name, load = self.name, self.load

        @F.pandas_udf("array<float>")
        def encode(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
            run = _loaded(name, load)
            for batch in batches:
                yield pd.Series(run(batch.fillna("").tolist()) if run is not None else [[]] * len(batch), index=batch.index)

        return encode(source)

    def vectors(self, fragments: DataFrame) -> DataFrame:
        """(fragment_id, embedding) of fragments; those whose vector is empty are left out."""
        source = text.embed_text(F.col("task_desc"), F.col("result_desc"), F.col("turns_text"))
        return fragments.select("fragment_id", self.column(source).alias("embedding")).where(F.size("embedding") > 0)


def backfill(fragments: DataFrame, encoder: Encoder) -> tuple[DataFrame, DataFrame]:
    """(vectors of all fragments, counts by status ok or skipped). Without an encoder it raises: no vector could be made."""
    if not encoder.ready:
        raise RuntimeError("backfill needs an encoder")
    vectors = encoder.vectors(fragments)
    return vectors, status(fragments, vectors).groupBy("status").count()


def status(fragments: DataFrame, vectors: DataFrame) -> DataFrame:
    """(fragment_id, status): ok if the fragment has a vector, else skipped."""
    have = vectors.select("fragment_id", F.lit("ok").alias("s")).distinct()
    return fragments.select("fragment_id").join(have, "fragment_id", "left").select("fragment_id", F.coalesce("s", F.lit("skipped")).alias("status"))


def missing(fragments: DataFrame, vectors: DataFrame) -> DataFrame:
    return fragments.join(vectors, "fragment_id", "left_anti")
