"""A keyed table in versions: repairs write only the buckets they change.

Rows lie in buckets by a hash of the key. A version is a manifest, a small table
that names the folder of every bucket. A change writes the buckets it touches to
a new folder and then its manifest, as one file that appears when it is whole; a
run that ends before that changes nothing, and old versions stay readable.
"""

from __future__ import annotations

import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .store import upsert_overwrite

MANIFEST = T.StructType([T.StructField("bucket", T.IntegerType()), T.StructField("folder", T.StringType())])


class VersionedTable:
    """``path`` holds the table; ``buckets`` bounds the manifest's rows and must
    stay the same for a table's life. A null key has a bucket like any other."""

    def __init__(self, spark: SparkSession, path: str, schema: T.StructType, key: str = "request_id", buckets: int = 64):
        self.spark, self.path, self.schema, self.key, self.buckets = spark, path.rstrip("/"), schema, key, buckets

    def _bucket(self) -> Column:
        return F.pmod(F.xxhash64(self.key), F.lit(self.buckets)).cast("int").alias("_bucket")

    def versions(self) -> list[int]:
        """Whole versions, ascending."""
        try:
            found = self.spark.read.schema(MANIFEST).parquet(f"{self.path}/manifest").select("version").distinct().collect()
        except AnalysisException as e:
            if e.getCondition() not in ("PATH_NOT_FOUND", "UNRESOLVED_COLUMN.WITH_SUGGESTION"):
                raise
            return []
        return sorted(int(r["version"]) for r in found)

    def _folders(self, version: int | None) -> dict[int, str]:
        """Folder of each bucket, one row a bucket."""
        known = self.versions()
        if version is None:
            version = known[-1] if known else None
        if version is None:
            return {}
        rows = self.spark.read.schema(MANIFEST).parquet(f"{self.path}/manifest/version={version}").collect()
        return {r["bucket"]: r["folder"] for r in rows if r["bucket"] >= 0}

    def _rows(self, folders: list[str]) -> DataFrame:
        if not folders:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(*folders)

    def read(self, version: int | None = None) -> DataFrame:
        """The table as of ``version`` (default: the last)."""
        return self._rows(sorted(self._folders(version).values()))

    def _commit(self, rows: DataFrame, kept: dict[int, str]) -> int:
        data = f"{self.path}/data/{uuid.uuid4().hex[:12]}"
        rows.select("*", self._bucket()).repartition(F.col("_bucket")).write.partitionBy("_bucket").parquet(data)
        written = self.spark.read.parquet(data).select("_bucket").distinct().collect() if not rows.isEmpty() else []
        kept = kept | {r["_bucket"]: f"{data}/_bucket={r['_bucket']}" for r in written}
        version = (self.versions() or [0])[-1] + 1
        # a row of its own, so that an empty table has a manifest too
        self.spark.createDataFrame([(-1, ""), *kept.items()], MANIFEST).coalesce(1) \
            .write.parquet(f"{self.path}/manifest/version={version}")
        return version

    def create(self, rows: DataFrame) -> int:
        """The first version (or a whole new one)."""
        return self._commit(rows.select(*self.schema.names), {})

    def merge(self, updates: DataFrame, order: str = "ordinal") -> int:
        """A new version with ``updates`` inserted or overwriting by key, the last
        by ``order``. Only buckets with an update are read and written."""
        touched = {r["_bucket"] for r in updates.select(self._bucket()).distinct().collect()}      # at most ``buckets``
        folders = self._folders(None)
        old = self._rows(sorted(f for b, f in folders.items() if b in touched))
        merged = upsert_overwrite(old, updates, self.key, order).select(*self.schema.names)
        return self._commit(merged, {b: f for b, f in folders.items() if b not in touched})
