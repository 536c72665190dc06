"""Index files: write, replace, delete and snapshot without a reader ever seeing half a state."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


class Store:
    """Tables below a folder. Each write stages its rows in a folder of its own and publishes them by creating the next
    numbered manifest, which fails if another writer has; readers take the highest, so they see one whole state or the next.
    """

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")
        jvm = spark.sparkContext._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.folder).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _manifest(self, name: str) -> dict:
        at = self._path(f"{self.folder}/{name}/manifests")
        if not self._fs.exists(at):
            return {"version": 0}
        numbers = [int(n) for s in self._fs.listStatus(at) if (n := s.getPath().getName()).isdigit()]
        if not numbers:
            return {"version": 0}
        return {"version": max(numbers)} | json.loads("\n".join(r[0] for r in self.spark.read.text(f"{self.folder}/{name}/manifests/{max(numbers):012d}").collect()))

    def read(self, name: str) -> DataFrame:
        now = self._manifest(name)
        if not now["version"]:
            raise FileNotFoundError(f"{self.folder}/{name}")
        return self.spark.read.schema(StructType.fromJson(now["schema"])).parquet(f"{self.folder}/{name}/{now['rows_in']}")

    def write(self, name: str, df: DataFrame, expected: int | None = None, upon: int | None = None) -> int:
        """Stages df, checks its count if one is expected, publishes it as the version after ``upon`` (the one read; by
        default the newest); returns the count. Raises FileExistsError, and publishes nothing, if that version exists."""
        version = (self._manifest(name)["version"] if upon is None else upon) + 1
        rows_in = f"rows-{version}-{uuid.uuid4().hex}"
        to = f"{self.folder}/{name}/{rows_in}"
        df.write.parquet(to)
        n = self.spark.read.schema(df.schema).parquet(to).count()
        if expected is not None and n != expected:
            self._fs.delete(self._path(to), True)
            raise ValueError(f"{name}: {n} rows staged, {expected} expected")
        body = json.dumps({"rows": n, "rows_in": rows_in, "schema": df.schema.jsonValue()})
        draft, final = self._path(f"{to}/_manifest"), self._path(f"{self.folder}/{name}/manifests/{version:012d}")
        out = self._fs.create(draft, True)
        out.write(bytearray(body.encode()))
        out.close()
        self._fs.mkdirs(final.getParent())
        if self._fs.exists(final) or not self._fs.rename(draft, final):
            self._fs.delete(self._path(to), True)
            raise FileExistsError(f"{name}: version {version} was written by another")
        return n

    def upsert(self, name: str, rows: DataFrame, key: str) -> int:
        """Replaces the rows of the given keys; columns that one side lacks become null. Of new rows of one key the greatest stays."""
        rest = [c for c in rows.columns if c != key]
        kinds = dict(rows.dtypes)
        order = F.struct(*((F.to_json(c) if kinds[c].startswith("map") else F.col(c)).alias(c) for c in rest))
        rows = rows.groupBy(key).agg(F.max_by(F.struct(*rest), order).alias("_r")).select(key, "_r.*") if rest else rows.distinct()
        now = self._manifest(name)["version"]
        if not now:
            return self.write(name, rows, upon=0)
        old = self.read(name).join(rows.select(key).distinct(), key, "left_anti")
        return self.write(name, old.unionByName(rows, allowMissingColumns=True), upon=now)

    def delete(self, name: str, **equal) -> int:
        """Deletes the rows whose columns have the given values, or one of a list; without any, none. Returns how many."""
        if not equal:
            return 0
        df, gone = self.read(name), F.lit(True)
        for column, value in equal.items():
            gone = gone & F.coalesce(F.col(column).isin(*value) if isinstance(value, (list, tuple, set)) else F.col(column) == value, F.lit(False))
        before = df.count()
        return before - self.write(name, df.filter(~gone))

    def snapshot(self, name: str, to: str) -> None:
        self.read(name).write.mode("overwrite").parquet(to)


def write_jsonl(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def read_jsonl(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """Rows of a JSON-lines file; lines that don't fit the schema become null."""
    return spark.read.schema(schema).json(path)
