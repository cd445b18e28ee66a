"""Jobs in stages that can be taken up where they ended.

Each stage writes its tables into a folder of its own attempt in the shared folder and then publishes
a manifest that names them; creating the manifest is the only step that counts, and it fails if there is
one already. A later run reads the tables of every published stage and starts with the first that has none, so a
lost executor costs tasks, and a lost driver one stage. Tables of attempts that were never published are deleted.
"""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

Tables = dict[str, DataFrame]


class Stages:
    """The stages of one job under ``root``."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self._path = spark._jvm.org.apache.hadoop.fs.Path
        self._files = self._path(self.root).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _manifest(self, stage: str):
        return self._path(f"{self.root}/{stage}.json")

    def published(self, stage: str) -> dict | None:
        path = self._manifest(stage)
        if not self._files.exists(path):
            return None
        stream = self._files.open(path)
        try:
            return json.loads(bytes(stream.readAllBytes()).decode())
        finally:
            stream.close()

    def _publish(self, stage: str, manifest: dict) -> bool:
        """False where another run was first."""
        aside = self._path(f"{self.root}/{stage}.{uuid.uuid4().hex}.json")
        stream = self._files.create(aside, False)
        stream.write(bytearray(json.dumps(manifest).encode()))
        stream.close()
        if self._files.exists(self._manifest(stage)) or not self._files.rename(aside, self._manifest(stage)):
            self._files.delete(aside, False)
            return False
        return True

    def read(self, stage: str) -> Tables:
        manifest = self.published(stage)
        return {name: self.spark.read.parquet(f"{self.root}/{manifest['folder']}/{name}") for name in manifest["tables"]}

    def run(self, stages: list[tuple[str, Callable[[Tables], Tables]]], inputs: Tables) -> Tables:
        """All tables of all stages; each stage gets the inputs and what the stages before it made."""
        known = dict(inputs)
        for number, (stage, make) in enumerate(stages):
            if self.published(stage) is None:
                began, folder, rows = time.time(), f"{stage}-{uuid.uuid4().hex}", {}
                try:
                    for name, df in make(known).items():
                        # Rows are counted as they are written.
                        count = Observation()
                        df.observe(count, F.count(F.lit(1)).alias("n")).write.parquet(f"{self.root}/{folder}/{name}")
                        rows[name] = count.get["n"]
                    if not self._publish(stage, {"folder": folder, "ord": number, "tables": rows, "began": began, "ended": time.time()}):
                        self._files.delete(self._path(f"{self.root}/{folder}"), True)
                except BaseException:
                    self._files.delete(self._path(f"{self.root}/{folder}"), True)
                    raise
            known |= self.read(stage)
        return known

    def events(self, stages: list[str]) -> DataFrame:
        """What a viewer may poll: a row for each stage, done or waiting; the first that waits is running or next."""
        rows = []
        for number, stage in enumerate(stages):
            m = self.published(stage)
            rows.append((stage, number, "done" if m else "waiting", m and m["ended"], m and m["tables"]))
        made = self.spark.createDataFrame(rows, "stage string, ord int, status string, ended double, tables map<string,bigint>")
        return made.select("stage", "ord", "status", F.timestamp_seconds("ended").alias("at"), "tables")
