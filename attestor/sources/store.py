"""Tables that are replaced while others read them.

A store is a folder with data folders that are never written twice and a manifest that names those in force, by part. A
write puts its rows into a new folder and then a new manifest in place of the old by one rename, which is atomic: readers
see the store before it or after it, and a write that breaks off leaves the old one in force. What no manifest names goes
with the next write; folders that the last write replaced stay until then, for readers that have begun. One writer at a
time; any number of readers.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from attestor.operators.prepare import latest

_MANIFEST = "_manifest.json"


class Store:
    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self._hadoop = spark._jvm.org.apache.hadoop.fs
        self._conf = spark._jsparkSession.sessionState().newHadoopConf()
        self._fs = self._at("").getFileSystem(self._conf)

    def _at(self, name: str):
        return self._hadoop.Path(f"{self.path}/{name}" if name else self.path)

    def _manifest(self) -> dict:
        """{parts: {part: folder}, previous: [folders]}"""
        if not self._fs.exists(self._at(_MANIFEST)):
            return {"parts": {}, "previous": []}
        source = self._fs.open(self._at(_MANIFEST))
        try:
            return json.loads(self.spark._jvm.org.apache.commons.io.IOUtils.toString(source, "UTF-8"))
        finally:
            source.close()

    def parts(self) -> list[str]:
        return sorted(self._manifest()["parts"])

    def read(self, part: str | None = None) -> DataFrame | None:
        """The rows in force, of one part or of all; None if there are none. Later writes don't change a frame that has been read, but the one after the next removes its files."""
        folders = [f for p, f in sorted(self._manifest()["parts"].items()) if part in (None, p)]
        return self.spark.read.option("mergeSchema", True).parquet(*(f"{self.path}/{f}" for f in folders)) if folders else None

    def _swap(self, manifest: dict) -> None:
        """Puts the manifest in place of the one in force."""
        name = f"_next-{uuid.uuid4().hex}"
        out = self._fs.create(self._at(name), True)
        out.write(bytearray(json.dumps(manifest, sort_keys=True).encode()))
        out.close()
        options = self.spark._sc._gateway.new_array(self._hadoop.Options.Rename, 1)
        options[0] = self._hadoop.Options.Rename.OVERWRITE
        self._hadoop.FileContext.getFileContext(self._fs.getUri(), self._conf).rename(self._at(name), self._at(_MANIFEST), options)

    def clean(self) -> list[str]:
        """Removes what no manifest names, such as the remains of a write that broke off; returns the names."""
        manifest = self._manifest()
        kept = {_MANIFEST, *manifest["parts"].values(), *manifest["previous"]}
        gone = []
        if self._fs.exists(self._at("")):
            for f in self._fs.listStatus(self._at("")):
                name = f.getPath().getName()
                if name not in kept and name.startswith(("data-", "_next-")):
                    self._fs.delete(f.getPath(), True)
                    gone.append(name)
        return gone

    def put(self, rows: DataFrame, part: str = "") -> None:
        """rows in place of the part's; other parts stay as they are. rows may come from the store itself."""
        self.clean()
        folder = f"data-{uuid.uuid4().hex}"
        rows.write.parquet(f"{self.path}/{folder}")
        before = self._manifest()["parts"]
        self._swap({"parts": before | {part: folder}, "previous": [before[part]] if part in before else []})

    def append(self, rows: DataFrame) -> None:
        """rows as a part of their own, as one step."""
        self.put(rows, f"part-{uuid.uuid4().hex}")

    def compact(self) -> None:
        """All parts as one."""
        held, manifest = self.read(), self._manifest()
        if held is not None and len(manifest["parts"]) > 1:
            folder = f"data-{uuid.uuid4().hex}"
            held.write.parquet(f"{self.path}/{folder}")
            self._swap({"parts": {"": folder}, "previous": list(manifest["parts"].values())})

    def upsert(self, new: DataFrame, keys: list[str], at: str = "updated_at", part: str = "") -> None:
        """The part's rows with new ones in place of older ones of their keys."""
        held = self.read(part)
        self.put(latest(new if held is None else held.unionByName(new, allowMissingColumns=True), keys, at), part)

    def replace_run(self, rows: DataFrame, run_id: str) -> None:
        """The rows of one run, and no others, as one step."""
        self.put(rows.withColumn("run_id", F.lit(run_id)), run_id)
