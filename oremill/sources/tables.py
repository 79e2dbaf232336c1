"""Keyed tables of settings and state over a catalog: buckets, sources, jobs, policies, run times."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F

from oremill.operators import access, upsert
from oremill.sources.catalog import Catalog

#: The keys of tables, columns that keep their first value, and the bucket that can't be deleted.
KEYS = {"buckets": ["id"], "sources": ["id"], "jobs": ["id"], "policies": ["id"], "run_times": ["bucket_id", "tenant_id"], "hashes": ["store_key"]}
FIRST = {"buckets": ("created_at", "embedding_model"), "sources": ("created_at",), "jobs": ("created_at",), "policies": ("created_at",)}
PROTECTED = "bkt_default"


class Table:
    """One keyed table: rows go in as a batch, the last by `seq` wins; reads are filters, pages and counts."""

    def __init__(self, catalog: Catalog, name: str):
        self.catalog, self.name, self.keys = catalog, name, KEYS[name]

    def all(self) -> DataFrame:
        return self.catalog.read(self.name)

    def put(self, rows: DataFrame) -> None:
        rows = rows if "seq" in rows.columns else rows.withColumn("seq", F.lit(0))
        old = self.catalog.read_or(self.name, rows)
        keep = tuple(c for c in FIRST.get(self.name, ()) if c in rows.columns)
        self.catalog.commit({self.name: upsert.keyed(old, rows, self.keys, keep_old=keep)})

    def patch(self, patches: DataFrame) -> None:
        """Non-null values of the given rows replace."""
        columns = tuple(c for c in patches.columns if c not in self.keys)
        self.catalog.commit({self.name: upsert.patch(self.all(), patches, self.keys[0], columns)})

    def get(self, **key: str) -> Row | None:
        return self.list(**key).first()

    def list(self, limit: int | None = None, offset: int = 0, order: list[Column] | None = None, **filters) -> DataFrame:
        """Rows equal to all filters (a list: one of), newest first or by `order`."""
        df = self.all()
        for c, v in filters.items():
            if v is not None:
                df = df.where(F.col(c).isin(v) if isinstance(v, list) else F.col(c) == v)
        order = order or ([F.desc("created_at")] if "created_at" in df.columns else []) + [F.col(k) for k in self.keys]
        return df if limit is None else access.page(df, order, limit, offset)

    def count(self, **filters) -> int:
        return self.list(**filters).count()

    def delete(self, **filters) -> None:
        given = access.require_filter(**filters)
        if self.name == "buckets" and given.get("id") == PROTECTED:
            raise ValueError("the default bucket stays")
        gone = F.lit(True)
        for c, v in given.items():
            gone = gone & (F.col(c).isin(v) if isinstance(v, list) else F.col(c).eqNullSafe(F.lit(v)))
        self.catalog.commit({self.name: self.all().where(~gone)})


def last_run(catalog: Catalog, bucket: str, tenant: str = "") -> dt.datetime | None:
    """The high-water mark of a bucket's ingestion."""
    if not catalog.exists("run_times"):
        return None
    row = Table(catalog, "run_times").get(bucket_id=bucket, tenant_id=tenant)
    return row["ran_at"] if row else None


def set_last_run(catalog: Catalog, bucket: str, at: dt.datetime, tenant: str = "") -> None:
    Table(catalog, "run_times").put(catalog.spark.createDataFrame([(bucket, tenant, at)], "bucket_id string, tenant_id string, ran_at timestamp"))
