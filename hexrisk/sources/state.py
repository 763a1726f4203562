"""A keyed state table with commits: readers see whole versions, and a merge rewrites only the buckets it touches.

Rows lie in buckets by a hash of their key. Every version has a manifest that names, for each bucket, the folder it lies in;
a merge writes the touched buckets under its own version and then the manifest, first as a draft, then under its final
name. The newest complete manifest is the table. A run that dies before that leaves the table as it was, and the same
version can be written again. Old manifests and the folders that only they name are dropped after a commit.
"""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession, functions as F

from hexrisk.session import file_system

BUCKETS = 64
#: Versions that readers may still hold.
KEPT_VERSIONS = 2


class StateTable:
    """``key`` is one column; of several updates of a key the one with the greatest ``order`` wins, and it beats the old row."""

    def __init__(self, spark: SparkSession, path: str, key: str = "cell", order: str = "scored_at", buckets: int = BUCKETS):
        self.spark, self.path, self.key, self.order, self.buckets = spark, path.rstrip("/"), key, order, buckets

    # Versions

    def versions(self) -> list[int]:
        """Numbers of all complete versions, ascending."""
        fs, folder = file_system(self.spark, f"{self.path}/manifests")
        if not fs.exists(folder):
            return []
        names = [s.getPath().getName() for s in fs.listStatus(folder)]
        return sorted(int(n.removesuffix(".json")) for n in names if n.endswith(".json"))

    def manifest(self, version: int | None = None) -> dict | None:
        """Version, schema, number of buckets and the folder of each bucket; null if nothing was committed."""
        versions = self.versions()
        if version is None and not versions:
            return None
        rows = self.spark.read.text(f"{self.path}/manifests/{versions[-1] if version is None else version}.json", wholetext=True)
        return json.loads(rows.first()[0])

    def read(self, version: int | None = None) -> DataFrame | None:
        """The newest version, or a given one; null if nothing was committed yet."""
        found = self.manifest(version)
        return None if found is None else self._rows(found, list(found["folders"]))

    def _rows(self, manifest: dict, buckets: list[str]) -> DataFrame:
        paths = [f"{self.path}/{manifest['folders'][b]}" for b in buckets if b in manifest["folders"]]
        schema = self.spark.createDataFrame([], manifest["schema"]).schema
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    # Commits

    def merge(self, updates: DataFrame, version: int | None = None) -> dict:
        """Merge ``updates`` and commit; returns the new manifest. A version that is committed already is left as it is.

        ``version`` makes a repeated run harmless (a stream passes its batch number); by default it is the next number.
        """
        now = self.manifest()
        if version is None:
            version = 0 if now is None else now["version"] + 1
        if now is not None and now["version"] >= version:
            return now
        count = self.buckets if now is None else now["buckets"]
        bucket = F.pmod(F.xxhash64(self.key), F.lit(count)).cast("int")
        columns = updates.columns
        # Updates are reduced and written before the old rows are read, so they are worked out once.
        newest = updates.groupBy(self.key).agg(F.max_by(F.struct(*columns), F.struct(F.col(self.order).isNotNull(), self.order)).alias("row")).select("row.*")
        draft = f"{self.path}/updates/{version}"
        newest.withColumn("bucket", bucket).write.mode("overwrite").partitionBy("bucket").parquet(draft)
        fs, folder = file_system(self.spark, draft)
        touched = sorted(s.getPath().getName().removeprefix("bucket=") for s in fs.listStatus(folder) if s.getPath().getName().startswith("bucket="))
        schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in updates.schema.fields)
        folders = {} if now is None else dict(now["folders"])
        if touched:
            fresh = self.spark.read.schema(updates.schema).parquet(*[f"{draft}/bucket={b}" for b in touched])
            merged = fresh
            if now is not None:
                old = self._rows(now, [b for b in touched if b in folders])
                stays = old.join(fresh.select(self.key), self.key, "left_anti").select(*old.columns)
                merged = stays.unionByName(fresh, allowMissingColumns=True)
                schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in merged.schema.fields)
            dealt = merged.withColumn("bucket", bucket).repartition(min(len(touched), count), "bucket")
            dealt.write.mode("overwrite").partitionBy("bucket").parquet(f"{self.path}/data/{version}")
            folders |= {b: f"data/{version}/bucket={b}" for b in touched}
        manifest = {"version": version, "buckets": count, "schema": schema, "folders": folders}
        self._publish(manifest)
        fs.delete(folder, True)
        self._drop_old()
        return manifest

    def _publish(self, manifest: dict) -> None:
        name = f"{self.path}/manifests/{manifest['version']}.json"
        fs, final = file_system(self.spark, name)
        _, draft = file_system(self.spark, name + ".draft")
        out = fs.create(draft, True)
        out.write(json.dumps(manifest).encode())
        out.close()
        if not fs.rename(draft, final):
            raise OSError(f"{name} was committed by another run")

    def _drop_old(self) -> None:
        versions = self.versions()
        kept = versions[-KEPT_VERSIONS:]
        named = {f for v in kept for f in self.manifest(v)["folders"].values()}
        for version in versions[:-KEPT_VERSIONS]:
            fs, old = file_system(self.spark, f"{self.path}/manifests/{version}.json")
            fs.delete(old, False)
        fs, data = file_system(self.spark, f"{self.path}/data")
        if not fs.exists(data):
            return
        for run in fs.listStatus(data):
            number = run.getPath().getName()
            if int(number) > kept[-1]:
                continue  # a run that is not committed yet
            for part in fs.listStatus(run.getPath()):
                if part.getPath().getName().startswith("bucket=") and f"data/{number}/{part.getPath().getName()}" not in named:
                    fs.delete(part.getPath(), True)
            if not any(s.getPath().getName().startswith("bucket=") for s in fs.listStatus(run.getPath())):
                fs.delete(run.getPath(), True)
