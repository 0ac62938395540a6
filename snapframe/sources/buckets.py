"""Keyed tables in hashed buckets: an upsert rewrites the buckets that it touches and publishes a new version.

    <path>/data/version=<v>/bucket=<b>/...   rows of bucket b as of version v
    <path>/manifest/version=<v>/...          which version's files each bucket has in version v

Data files are never changed. A version is there once its manifest is committed, which Spark's
writer does in one step; what a crashed upsert has written before that is never read, and the
upsert can run again.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from snapframe.operators.upsert import upsert

BUCKETS = 64
_MANIFEST = "bucket int, data long, buckets int, version long"


class BucketTable:
    """A table of `schema` whose rows are told apart by `keys` and, null being equal to null, `nullable`.

    The number of buckets is fixed by the first version; later callers take it from there. It bounds
    what the manifest holds and what an upsert of a few keys rewrites.
    """

    def __init__(self, spark: SparkSession, path: str, schema: str, keys: Sequence[str], nullable: Sequence[str] = (), buckets: int = BUCKETS):
        self.spark, self.path, self.schema = spark, path.rstrip("/"), schema
        self.keys, self.nullable, self.buckets = list(keys), list(nullable), buckets

    def _published(self) -> list:
        """Manifest rows of the latest version: one for each bucket that has rows."""
        try:
            every = self.spark.read.schema(_MANIFEST).parquet(f"{self.path}/manifest")
        except AnalysisException:  # nothing published yet
            return []
        last = every.agg(F.max("version")).first()[0]
        return every.filter(F.col("version") == last).collect() if last is not None else []

    def version(self) -> int | None:
        rows = self._published()
        return rows[0]["version"] if rows else None

    def _bucket(self, buckets: int) -> Column:
        return F.pmod(F.xxhash64(*(F.coalesce(F.col(k).cast("string"), F.lit("\x00")) for k in (*self.keys, *self.nullable))), F.lit(buckets)).cast("int")

    def _read(self, rows: list) -> DataFrame:
        paths = [f"{self.path}/data/version={r['data']}/bucket={r['bucket']}" for r in rows if r["data"] >= 0]
        return self.spark.read.schema(self.schema).parquet(*paths) if paths else self.spark.createDataFrame([], self.schema)

    def read(self) -> DataFrame:
        """The rows of the latest version; none before the first."""
        return self._read(self._published())

    def upsert(self, changes: DataFrame, version: int, order: str) -> bool:
        """Publish `version` with the changes merged in; False, changing nothing, if that or a later one is there.

        Of several changes to a key the last by the column `order` counts, which must rise from change
        to change. Versions rise; repeating one, as a restarted stream does, has no effect.
        """
        if order not in changes.columns:
            raise ValueError(f"changes need the column {order} that orders them")
        before = self._published()
        if before and before[0]["version"] >= version:
            return False
        buckets = before[0]["buckets"] if before else self.buckets
        dealt = changes.withColumn("_bucket", self._bucket(buckets))
        touched = {r[0] for r in dealt.select("_bucket").distinct().collect()}  # at most `buckets`
        held = {r["bucket"]: r["data"] for r in before if r["data"] >= 0}
        old = self._read([r for r in before if r["bucket"] in touched])
        merged = upsert(old, changes, self.keys, self.nullable, order).withColumn("bucket", self._bucket(buckets))
        if touched:
            merged.repartition(len(touched), "bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{self.path}/data/version={version}")
        rows = [(b, version if b in touched else held[b], buckets) for b in sorted(touched | set(held))] or [(0, -1, buckets)]
        self._publish(rows, version)
        return True

    def _publish(self, rows: list[tuple[int, int, int]], version: int) -> None:
        manifest = self.spark.createDataFrame(rows, "bucket int, data long, buckets int")
        manifest.coalesce(1).withColumn("version", F.lit(version).cast("long")).write.mode("append").partitionBy("version").parquet(f"{self.path}/manifest")
