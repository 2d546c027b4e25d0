"""A table kept on disk in versions, of which a merge rewrites only the partitions it changes."""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cartoweave.session import materialise

#: Rows that a partition of a store is laid out for at its first load.
ROWS_PER_BUCKET = 2_000_000


class BucketStore:
    """A table kept on disk, partitioned by a hash of its keys; a merge writes the partitions it changes beside the last ones.

    ``path`` is a folder all executors reach. A version is a manifest that names the folder of every partition and is put in
    place by one rename after its data are complete, so a merge that is lost half-way leaves the former version in force.
    The number of partitions follows the size of the first load.
    """

    def __init__(self, spark: SparkSession, path: str, keys: tuple[str, ...], rows_per_bucket: int = ROWS_PER_BUCKET) -> None:
        self.spark, self.path, self.rows_per_bucket, self.keys = spark, path.rstrip("/"), rows_per_bucket, keys

    def _fs(self):  # noqa: ANN202
        jvm = self.spark._jvm
        path = jvm.org.apache.hadoop.fs.Path
        return path, path(self.path).getFileSystem(self.spark._jsc.hadoopConfiguration())

    def version(self) -> int:
        """The last complete version; 0 where there is none."""
        path, fs = self._fs()
        root = path(f"{self.path}/manifests")
        return max((int(x.getPath().getName()) for x in fs.listStatus(root) if x.getPath().getName().isdigit()), default=0) if fs.exists(root) else 0

    def _manifest(self, version: int) -> dict:
        path, fs = self._fs()
        stream = fs.open(path(f"{self.path}/manifests/{version}"))
        try:
            return json.loads(self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def _commit(self, version: int, manifest: dict) -> None:
        path, fs = self._fs()
        stream = fs.create(path(f"{self.path}/manifests/_{version}"), True)
        stream.write(json.dumps(manifest).encode())
        stream.close()
        if not fs.rename(path(f"{self.path}/manifests/_{version}"), path(f"{self.path}/manifests/{version}")):
            raise RuntimeError(f"version {version} of {self.path} was written twice")

    def _read(self, manifest: dict, buckets: list[int] | None = None) -> DataFrame:
        chosen = [f"{self.path}/data/{manifest['at'][str(b)]}/bucket={b}" for b in (buckets if buckets is not None else range(manifest["buckets"])) if str(b) in manifest["at"]]
        schema = manifest["schema"]
        return self.spark.read.schema(schema).parquet(*chosen) if chosen else self.spark.createDataFrame([], schema)

    def table(self) -> DataFrame | None:
        """The table in force, or None before the first merge."""
        v = self.version()
        return self._read(self._manifest(v)) if v else None

    def merged(self, deltas: DataFrame, merge: Callable[[DataFrame | None, DataFrame], DataFrame], again: bool = False) -> tuple[int, DataFrame]:
        """Merge ``deltas`` (they have the keys); the number of the new version and what ``merge`` made of the touched partitions.

        ``merge`` takes the stored rows of these partitions (None at the first load) and the deltas. Its column ``before`` is
        not written, nor are rows whose ``copies``, if there is such a column, are gone. With ``again`` the caller uses the
        merged rows once more, so they are computed into a checkpoint first.
        """
        v = self.version() + 1
        deltas = materialise(deltas)
        manifest = self._manifest(v - 1) if v > 1 else {"buckets": max(1, -(-deltas.count() // self.rows_per_bucket)), "at": {}}
        n = manifest["buckets"]
        bucket = F.pmod(F.xxhash64(*self.keys), F.lit(n)).cast("int")
        touched = [r[0] for r in deltas.select(bucket.alias("b")).distinct().collect()] if v > 1 else list(range(n))
        merged = merge(self._read(manifest, touched) if v > 1 else None, deltas)
        merged = materialise(merged) if again else merged
        kept = merged.drop("before").where("copies > 0") if "copies" in merged.columns else merged
        manifest["schema"] = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema.fields)
        kept.withColumn("bucket", bucket).repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{self.path}/data/{v}")
        path, fs = self._fs()
        for b in touched:
            if fs.exists(path(f"{self.path}/data/{v}/bucket={b}")):
                manifest["at"][str(b)] = v
            else:
                manifest["at"].pop(str(b), None)
        self._commit(v, manifest)
        return v, merged
