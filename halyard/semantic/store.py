"""Versioned tables of the catalogue: one writer, readers see whole versions.

Each table has a folder with a Parquet folder for each version; the file CURRENT
names the versions that belong together and the revision of the grants. It is
replaced in one step, so that several tables change at once or not at all."""

from __future__ import annotations

import json
import os
import shutil
import uuid
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

from halyard.errors import invalid
from halyard.semantic.model import SCHEMAS


class Store:
    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, Path(root)
        self.root.mkdir(parents=True, exist_ok=True)

    def _current(self) -> dict:
        p = self.root / "CURRENT"
        return json.loads(p.read_text()) if p.exists() else {"tables": {}, "revision": 0}

    @property
    def revision(self) -> int:
        return self._current()["revision"]

    def read(self, name: str) -> DataFrame:
        """The current version of a table; one never written is empty."""
        at = self._current()["tables"].get(name)
        if at is None:
            return self.spark.createDataFrame([], SCHEMAS[name])
        return self.spark.read.schema(SCHEMAS[name]).parquet(str(self.root / name / at))

    def write(self, tables: dict[str, DataFrame], bump: bool = False) -> None:
        """New versions of the tables, visible together; bump raises the revision."""
        now = self._current()
        for name, df in tables.items():
            at = uuid.uuid4().hex
            df.write.parquet(str(self.root / name / at))
            now["tables"][name] = at
        now["revision"] += bump
        tmp = self.root / f".CURRENT-{uuid.uuid4().hex}"
        tmp.write_text(json.dumps(now))
        os.replace(tmp, self.root / "CURRENT")

    def vacuum(self) -> int:
        """Remove versions that aren't current; number of them."""
        live, n = self._current()["tables"], 0
        for name in SCHEMAS:
            for p in (self.root / name).glob("*"):
                if p.name != live.get(name):
                    shutil.rmtree(p)
                    n += 1
        return n

    def backup(self, to: str) -> None:
        """Copy the current versions into another folder, which must not exist."""
        dst = Path(to)
        if dst.resolve() == self.root.resolve():
            raise invalid("same_path", "a store can't be copied onto itself", path=to)
        if dst.exists():
            raise invalid("exists", f"{to} is already there", path=to)
        now = self._current()
        for name, at in now["tables"].items():
            shutil.copytree(self.root / name / at, dst / name / at)
        dst.mkdir(parents=True, exist_ok=True)
        (dst / "CURRENT").write_text(json.dumps(now))
