"""Shared plumbing of the operators: reading, Arrow maps, memos."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from oremill.plans.scratch import clear, discard, drop, noted, store  # noqa: F401
from oremill.plans.shipping import ship

#: Rows in one Arrow batch sent to Python: at 20,000 words a row this stays near 100 MB.
ARROW_ROWS = 512


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def prepare(spark: SparkSession) -> None:
    """Ship the package, and keep this session's Arrow batches at ARROW_ROWS rows at most: whole texts make the usual ones too large."""
    ship(spark)
    if int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch", "10000")) > ARROW_ROWS:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ARROW_ROWS))


def map_arrow(df: DataFrame, fn: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """mapInArrow with the session prepared."""
    prepare(df.sparkSession)
    return df.mapInArrow(fn, schema)


class Memo(dict):
    """A dict that computes what it lacks, of two generations: when the younger one holds half of `most` entries or of `chars`
    characters it becomes the older one, which is forgotten; what is found there is young again."""

    def __init__(self, make: Callable | None, most: int = 200_000, chars: int = 8_000_000, longest: int = 256):
        super().__init__()
        self.make, self.most, self.chars, self.longest, self.held, self.old = make, most // 2, chars // 2, longest, 0, {}

    def reset(self) -> None:
        self.clear()
        self.held, self.old = 0, {}

    def __reduce__(self):
        return Memo, (self.make, 2 * self.most, 2 * self.chars, self.longest)  # what it holds stays behind

    def __missing__(self, key):
        out = self.old.get(key)
        if out is None:
            out = self.make(key)
        self.put(key, out)
        return out

    def put(self, key, out) -> None:
        if len(key) <= self.longest:
            if len(self) >= self.most or self.held > self.chars:
                self.old = dict(self)
                self.clear()
                self.held = 0
            self.held += len(key)
            self[key] = out
