"""Tables with versions in one shared folder, replaced bucket by bucket.

    <root>/<table>/data=<version>/bucket=<k>/   rows, written once
    <root>/manifest/version=<version>/          one file: which version's rows each bucket has

A version is whole once its manifest is there; the manifest is written last, as one file that appears at
once.  A reader is bound to the version that it opened and reads that version's folders whatever is
written meanwhile.  A write that failed leaves folders that no manifest names and the next write of the
same version replaces.  One writer at a time; buckets that a write doesn't replace are not touched.
"""

from __future__ import annotations

from collections import defaultdict
from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textlake.sources.tables import WIDE_ROWS


def _load(spark: SparkSession, path: str, columns: str) -> DataFrame | None:
    try:
        return spark.read.schema(columns).parquet(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return None


_MANIFEST = "batch long, bucket int, data int"


@dataclass(frozen=True)
class Store:
    """``schemas``: the columns of each table as DDL, without data and bucket."""

    spark: SparkSession
    root: str
    schemas: dict[str, str]

    def versions(self) -> list[int]:
        found = _load(self.spark, f"{self.root}/manifest", f"{_MANIFEST}, version int")
        return [] if found is None else sorted(r.version for r in found.select("version").distinct().collect())

    def open(self, version: int | None = None) -> Snapshot:
        """The latest version or the one asked for; version 0 is empty."""
        if version is None:
            version = max(self.versions(), default=0)
        if not version:
            return Snapshot(self, 0, -1, {})
        rows = self.spark.read.schema(_MANIFEST).parquet(f"{self.root}/manifest/version={version}").collect()  # a row for each bucket
        return Snapshot(self, version, rows[0].batch, {r.bucket: r.data for r in rows if r.bucket is not None})

    def manifests(self) -> DataFrame:
        """(version, bucket, data) of every version."""
        columns = f"{_MANIFEST}, version int"
        found = _load(self.spark, f"{self.root}/manifest", columns)
        return (self.spark.createDataFrame([], columns) if found is None else found).where("bucket is not null").select("version", "bucket", "data")

    def parts(self, table: str) -> DataFrame:
        """All written rows of a table, each once, with data and bucket; ``manifests`` says which versions
        read them."""
        columns = f"{self.schemas[table]}, data int, bucket int"
        found = _load(self.spark, f"{self.root}/{table}", columns)
        return self.spark.createDataFrame([], columns) if found is None else found

    def begin(self, batch: int = -1) -> Write:
        """``batch``: a number of the input, which a caller that may be run again compares with the one of
        the version it finds."""
        return Write(self, self.open(), batch)

    def expire(self, keep: int = 2) -> list[int]:
        """Removes all but the last ``keep`` versions, with the rows that no kept one reads."""
        all_ = self.versions()
        kept = [self.open(v) for v in all_[-keep:]]
        used = {d for s in kept for d in s.buckets.values()} | {s.version for s in kept}
        gone = all_[:-keep]
        hadoop, conf = self.spark._jvm.org.apache.hadoop.fs, self.spark._jsc.hadoopConfiguration()
        old = [f"manifest/version={v}" for v in gone] + [f"{t}/data={d}" for t in self.schemas for d in range(1, max(all_, default=0) + 1) if d not in used]
        for folder in old:
            at = hadoop.Path(f"{self.root}/{folder}")
            at.getFileSystem(conf).delete(at, True)
        return gone


@dataclass(frozen=True)
class Snapshot:
    store: Store
    version: int
    batch: int
    #: The version whose rows a bucket has.
    buckets: dict[int, int]

    def read(self, table: str, buckets: list[int] | None = None) -> DataFrame:
        """The rows of a table with their bucket; ``buckets`` leaves the folders of all others out."""
        spark, columns = self.store.spark, self.store.schemas[table]
        wanted, only = defaultdict(list), None if buckets is None else set(buckets)
        for b, d in self.buckets.items():
            if only is None or b in only:
                wanted[d].append(b)
        rows = _load(spark, f"{self.store.root}/{table}", f"{columns}, data int, bucket int") if wanted else None
        if rows is None:  # no bucket, or a table that was never written
            return spark.createDataFrame([], f"{columns}, bucket int")
        keep = F.lit(False)
        for d, own in sorted(wanted.items()):
            keep |= (F.col("data") == d) & F.col("bucket").isin(sorted(own))
        return rows.where(keep).drop("data")


@dataclass(frozen=True)
class Write:
    store: Store
    base: Snapshot
    batch: int

    @property
    def version(self) -> int:
        return self.base.version + 1

    def put(self, table: str, rows: DataFrame, order: tuple[str, ...], **options: str) -> DataFrame:
        """Writes rows (…, bucket) of the buckets that this write replaces, in their order inside each
        file, and reads them back.  The caller has dealt them out by bucket."""
        fields = self.store.spark.createDataFrame([], self.store.schemas[table]).schema
        path = f"{self.store.root}/{table}/data={self.version}"
        rows = rows.select(*(F.col(f.name).cast(f.dataType).alias(f.name) for f in fields), F.col("bucket").cast("int").alias("bucket"))
        rows.sortWithinPartitions("bucket", *order).write.mode("overwrite").options(**WIDE_ROWS, **options).partitionBy("bucket").parquet(path)
        return self.store.spark.read.schema(f"{self.store.schemas[table]}, bucket int").parquet(path)

    def publish(self, replaced: list[int], data: int | None = None) -> Snapshot:
        """Makes the version readable: ``replaced`` buckets have what was put, all others what they had.
        ``data``: the version whose write has put them, if it is an earlier one."""
        new = dict.fromkeys(replaced, data or self.version)
        buckets = {b: d for b, d in self.base.buckets.items() if b not in new} | new
        rows = [(self.batch, None, None), *((self.batch, b, d) for b, d in sorted(buckets.items()))]
        self.store.spark.createDataFrame(rows, _MANIFEST).coalesce(1).write.mode("overwrite").parquet(f"{self.store.root}/manifest/version={self.version}")
        return Snapshot(self.store, self.version, self.batch, buckets)
