"""Snapshot tables keyed by run: a run's tables become visible together, by its manifest, and old runs are removed.

``<root>/<table>/run=<id>`` holds a run's rows, ``<root>/_runs/<id>.json`` its manifest. A run without manifest is not there for
readers, whether it is still being written or was lost. The manifest is written beside its place and renamed into it.
"""

from __future__ import annotations

from collections.abc import Iterable
import json
import time
import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F

from skein.session import delete_path

MANIFESTS = "_runs"


class RunStore:
    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def _path(self, *parts: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path("/".join((self.root, *parts)))

    def _files(self):
        return self._path().getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _names(self, *parts: str) -> list[str]:
        fs, path = self._files(), self._path(*parts)
        return [s.getPath().getName() for s in fs.listStatus(path)] if fs.exists(path) else []

    def start(self) -> str:
        """The id of a new run; ids sort by the time they were made."""
        return f"{time.time_ns():020d}-{uuid.uuid4().hex[:8]}"

    def write(self, run: str, table: str, rows: DataFrame) -> None:
        """Write a table of an open run; written a second time, as after a crash, it replaces the first."""
        rows.write.mode("overwrite").parquet(f"{self.root}/{table}/run={run}")

    def commit(self, run: str, tables: Iterable[str]) -> None:
        """Make the run's tables visible. Committing again changes nothing."""
        fs = self._files()
        place, beside = self._path(MANIFESTS, f"{run}.json"), self._path(MANIFESTS, f".{run}-{uuid.uuid4().hex}")
        if fs.exists(place):
            return
        out = fs.create(beside, False)
        out.write(bytearray(json.dumps({"run": run, "tables": sorted(tables)}).encode()))
        out.close()
        if not fs.rename(beside, place):
            fs.delete(beside, False)
            if not fs.exists(place):
                raise OSError(f"run {run} could not be committed")

    def save(self, tables: dict[str, DataFrame]) -> str:
        """Write and commit one run."""
        run = self.start()
        for name, rows in tables.items():
            self.write(run, name, rows)
        self.commit(run, tables)
        return run

    def completed(self) -> list[str]:
        """Ids of the committed runs, oldest first."""
        return sorted(n[:-5] for n in self._names(MANIFESTS) if n.endswith(".json") and not n.startswith("."))

    def _tables(self, run: str) -> list[str]:
        text = self.spark.read.text(f"{self.root}/{MANIFESTS}/{run}.json", wholetext=True).first()[0]
        return json.loads(text)["tables"]

    def read(self, table: str, run: str | None = None) -> DataFrame:
        """A table of a committed run, of the latest one by default."""
        runs = [r for r in self.completed() if run in (None, r)]
        found = next((r for r in reversed(runs) if table in self._tables(r)), None)
        if found is None:
            raise LookupError(f"no committed run {run or ''} with table {table}")
        return self.spark.read.parquet(f"{self.root}/{table}/run={found}")

    def history(self, table: str) -> DataFrame:
        """A table over all committed runs, with their id in ``run``."""
        frames = [self.read(table, r).withColumn("run", F.lit(r)) for r in self.completed() if table in self._tables(r)]
        if not frames:
            raise LookupError(f"no committed run with table {table}")
        out = frames[0]
        for frame in frames[1:]:
            out = out.unionByName(frame)
        return out

    def retain(self, keep: int, open_for: float = 86_400.0) -> list[str]:
        """Remove all but the latest ``keep`` committed runs, and runs that stay uncommitted ``open_for`` seconds after their start.

        Manifests go first: what is left of a run whose removal breaks off is invisible, and goes the next time.
        """
        if keep < 1:
            raise ValueError("at least the latest run stays")
        old = self.completed()[:-keep]
        for run in old:
            delete_path(self.spark, f"{self.root}/{MANIFESTS}/{run}.json")
        kept, latest = set(self.completed()), time.time_ns() - int(open_for * 1e9)
        removed = set(old)
        for table in self._names():
            for run in [n[4:] for n in self._names(table) if n.startswith("run=")]:
                if run not in kept and (run in removed or int(run.split("-")[0]) < latest):
                    delete_path(self.spark, f"{self.root}/{table}/run={run}")
                    removed.add(run)
        return sorted(removed)
