"""Tables in folders by source and bucket of the path: a write replaces the partitions it touches and no other.

Every row belongs to a source and a path. A write reads the touched partitions, leaves out the rows of the
paths that go, adds the new ones and lets Spark's writer overwrite those partitions dynamically. Each touched
partition holds one row without a path, so that one which has lost all its rows is overwritten as well.
The number of buckets is the store's for good: choose it so that a bucket of the largest source is some hundred
megabytes. Writes of one table are one commit of Spark; a run writes the table of files last, so a run that breaks off
is done again by the next one.
"""

from __future__ import annotations

import tempfile
import uuid
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

VERSION = "2"
KEYS = ["source", "path"]
#: Columns of each table behind source and path.
TABLES = {
    "meta": "value string, updated_at timestamp",
    "source": "kind string, root_path string, remote_url string, last_indexed timestamp",
    "file": "kind string, language string, hash string, updated timestamp",
    "symbol": "kind string, name string, fqn string, signature string, start_line int, end_line int, hash string",
    "candidate": "what string, fqn string, target string, confidence double, evidence string",
    "document": "title string, aliases array<string>, tags array<string>, body string, hash string, updated timestamp",
    "chunk": "parent string, ordinal int, text string, embedding array<float>",
    "edge": "relation string, src string, dst string, confidence double, evidence string, promoted_from string",
    "decision": "title string, body string, created_at timestamp, created_by string, about array<string>",
}
META = "meta"


def shared_folder(spark: SparkSession) -> str:
    """The folder that all executors share, as the session names it; a local one only where it is unset and one process does it all (tests)."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    master = spark.sparkContext.master
    if not master.startswith("local") or master.startswith("local-cluster"):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    return f"file://{tempfile.mkdtemp(prefix='spark-store-')}"


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a table in the shared folder, for what is used more than once."""
    path = f"{shared_folder(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


class Store:
    def __init__(self, spark: SparkSession, root: str, buckets: int = 64):
        self.spark, self.root, self.buckets = spark, root.rstrip("/"), buckets

    def schema(self, table: str) -> StructType:
        return StructType.fromDDL(f"path string, {TABLES[table]}, source string, bucket int")

    def _exists(self, path: str) -> bool:
        at = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        return at.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(at)

    def _all(self, table: str) -> DataFrame:
        if self._exists(f"{self.root}/{table}"):
            return self.spark.read.schema(self.schema(table)).parquet(f"{self.root}/{table}")
        # known to be empty when a query is planned, so that nothing is shuffled to be joined with it
        return self.spark.range(1).where("false").select(*(F.lit(None).cast(f.dataType).alias(f.name) for f in self.schema(table)))

    def read(self, table: str) -> DataFrame:
        """All rows of a table, none if nothing was written yet."""
        return self._all(table).where("path is not null").drop("bucket")

    def of(self, table: str, paths: DataFrame, parts: list[tuple[str, int]] | None = None) -> DataFrame:
        """Rows of the given (source, path), from their partitions alone."""
        return self._touched(table, self.parts(paths) if parts is None else parts).join(paths.select(KEYS).distinct(), KEYS, "left_semi").drop("bucket")

    def _bucket(self) -> F.Column:
        return F.pmod(F.xxhash64("path"), F.lit(self.buckets)).cast("int").alias("bucket")

    def parts(self, paths: DataFrame) -> list[tuple[str, int]]:
        """Partitions of the paths; at most sources times buckets."""
        return [tuple(r) for r in paths.select("source", self._bucket()).distinct().collect()]

    def _touched(self, table: str, parts: list[tuple[str, int]]) -> DataFrame:
        by_source: dict[str, list[int]] = {}
        for source, bucket in parts:
            by_source.setdefault(source, []).append(bucket)
        wanted = reduce(lambda a, b: a | b, ((F.col("source") == s) & F.col("bucket").isin(b) for s, b in by_source.items()), F.lit(False))
        return self._all(table).where(wanted & F.col("path").isNotNull())

    def put(self, table: str, rows: DataFrame | None, gone: DataFrame | None = None, parts: list[tuple[str, int]] | None = None) -> int:
        """Takes away all rows of the paths in gone (source, path), then adds rows, which must be of those paths; without gone it only adds.

        parts: the partitions of gone, where they are known. Returns how many partitions were written.
        """
        if parts is None:
            parts = self.parts(rows if gone is None else gone)
        if not parts:
            return 0
        schema = self.schema(table)
        left = self._touched(table, parts)
        if gone is not None:
            left = left.join(gone.select(KEYS).distinct(), KEYS, "left_anti")
        marks = self.spark.createDataFrame(parts, "source string, bucket int")
        out = left.unionByName(marks, allowMissingColumns=True)
        if rows is not None:
            out = out.unionByName(rows.withColumn("bucket", self._bucket()), allowMissingColumns=True)
        out = out.select(*(F.col(f.name).cast(f.dataType) for f in schema))
        # partitions are gathered for the writer; Spark splits those that are large at run time
        out.hint("rebalance", "source", "bucket").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("source", "bucket").parquet(f"{self.root}/{table}")
        return len(parts)

    def upsert(self, table: str, rows: DataFrame) -> int:
        """Replaces the rows of the same source and path; of equal new ones the one with the largest values stays."""
        return self.put(table, self.one_each(rows), rows)

    @staticmethod
    def one_each(rows: DataFrame, keys: list[str] = KEYS) -> DataFrame:
        rest = [c for c in rows.columns if c not in keys]
        return rows.groupBy(keys).agg(F.max(F.struct(*rest)).alias("_row")).select(*keys, "_row.*") if rest else rows.distinct()

    def insert_missing(self, table: str, rows: DataFrame, keys: list[str]) -> int:
        """Adds rows whose keys (source and path among them) aren't there; returns how many were new."""
        new = self.staged(rows.dropDuplicates(keys).join(self.of(table, rows).select(keys), keys, "left_anti"))
        n = new.count()
        if n:
            self.put(table, new)
        return n

    def staged(self, df: DataFrame) -> DataFrame:
        """df written below the store's folder and read back: later writes don't change it, lost executors don't compute it again."""
        path = f"{self.root}/_stage/{uuid.uuid4().hex}"
        df.write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def clear_stage(self) -> None:
        at = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.root}/_stage")
        at.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)

    # --- meta ------------------------------------------------------------------------------------

    def write_meta(self, **values: str | None) -> None:
        """Sets keys; None takes a key away."""
        rows = self.spark.createDataFrame([(META, k, v) for k, v in values.items()], "source string, path string, value string")
        self.put("meta", rows.where("value is not null").withColumn("updated_at", F.current_timestamp()), rows)

    def meta(self, key: str) -> str | None:
        row = self.of("meta", self.spark.createDataFrame([(META, key)], "source string, path string")).select("value").first()
        return row["value"] if row else None

    def migrate(self) -> None:
        """Notes the version of the tables once; running it again changes nothing."""
        if self.meta("schema_version") != VERSION:
            self.write_meta(schema_version=VERSION)
