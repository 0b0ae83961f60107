"""Tables that change as one: a version's folders are written first, the manifest that names them last.

A reader takes the highest manifest, so it sees all tables of a version or none; a run that is killed before the
manifest leaves folders that nobody names, and the old version as it was.
"""

from __future__ import annotations

import json
import uuid
from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession


#: Folders of a table are named by a column that readers drop, so that columns below it stay partitions.
FOLDER = "in_folder"


class Conflict(RuntimeError):
    """Another run committed first."""


class Staged(NamedTuple):
    """A folder of a table that is written whole, and that no version names yet."""

    name: str
    folder: str
    schema: str


class Store:
    """Named tables under a folder that all executors reach, at one version: the newest when the store was opened."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self._fs = self._at("").getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        self.version, self.tables = 0, {}
        if names := self._manifests():
            self.version = int(names[-1].removesuffix(".json"))
            text = "\n".join(r[0] for r in spark.read.text(f"{self.path}/_versions/{names[-1]}", wholetext=True).collect())
            self.tables: dict[str, dict] = json.loads(text)

    def _at(self, name: str):
        return self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}" if name else self.path)

    def _manifests(self) -> list[str]:
        folder = self._at("_versions")
        return sorted(s.getPath().getName() for s in self._fs.listStatus(folder) if s.getPath().getName().endswith(".json")) if self._fs.exists(folder) else []

    def read(self, name: str) -> DataFrame | None:
        """The table's rows at this version, whatever is committed later; None where it has none yet."""
        if name not in self.tables:
            return None
        own = self.tables[name]
        return self._rows(name, own["schema"], own["folders"])

    def _rows(self, name: str, schema: str, folders: list[str]) -> DataFrame:
        found = self.spark.read.schema(schema).option("basePath", f"{self.path}/{name}").parquet(*[f"{self.path}/{f}" for f in folders])
        return found.drop(FOLDER)

    def stage(self, name: str, df: DataFrame, by: str | None = None) -> Staged:
        """df written as rows of a table, for a commit to name; `by` names a column whose values are folders."""
        folder = f"{name}/{FOLDER}=v{uuid.uuid4().hex}"
        writer = df.write.partitionBy(by) if by else df.write
        writer.parquet(f"{self.path}/{folder}")
        fields = [f for f in df.schema if f.name != by] + [f for f in df.schema if f.name == by]
        return Staged(name, folder, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in fields))

    def staged(self, s: Staged) -> DataFrame:
        """The rows that were staged, so that what follows from them needn't make them again."""
        return self._rows(s.name, s.schema, [s.folder])

    def commit(self, replace: dict[str, DataFrame | Staged] | None = None, append: dict[str, DataFrame | Staged] | None = None, by: dict[str, str] | None = None) -> Store:
        """The store at the next version: tables of `replace` are new, rows of `append` are added to theirs, others stay.

        `by` names a column whose values are folders of a table. What is read from this store while it is written stays
        as it is, since folders are never written over. Where another run has committed meanwhile, nothing changes and
        Conflict is raised.
        """
        tables = dict(self.tables)
        for rows, keep in ((replace or {}, False), (append or {}, True)):
            for name, df in rows.items():
                own = df if isinstance(df, Staged) else self.stage(name, df, (by or {}).get(name))
                kept = tables[name]["folders"] if keep and name in tables else []
                tables[name] = {"schema": own.schema, "folders": [*kept, own.folder]}
        self._publish(tables)
        return Store(self.spark, self.path)

    def _publish(self, tables: dict) -> None:
        name = f"_versions/{self.version + 1:010d}.json"
        draft = f"_drafts/{uuid.uuid4().hex}.json"
        out = self._fs.create(self._at(draft), True)
        out.write(bytearray(json.dumps(tables).encode()))
        out.close()
        self._fs.mkdirs(self._at("_versions"))
        # A rename puts the whole manifest in place; it doesn't replace one that is there.
        if self._fs.exists(self._at(name)) or not self._fs.rename(self._at(draft), self._at(name)):
            self._fs.delete(self._at(draft), False)
            raise Conflict(f"version {self.version + 1} of {self.path} is taken")

    def clear_old(self, versions: int = 2) -> int:
        """Delete folders that none of the last so many versions names, and older manifests; returns how many folders went. No load may run meanwhile."""
        names = self._manifests()
        named = set()
        for n in names[-versions:]:
            text = self.spark.read.text(f"{self.path}/_versions/{n}", wholetext=True).first()[0]
            named |= {f for t in json.loads(text).values() for f in t["folders"]}
        gone = 0
        for table in (s.getPath().getName() for s in self._fs.listStatus(self._at("")) if s.isDirectory()):
            if table.startswith("_"):
                continue
            for s in self._fs.listStatus(self._at(table)):
                if f"{table}/{s.getPath().getName()}" not in named:
                    self._fs.delete(s.getPath(), True)
                    gone += 1
        for n in names[:-versions]:
            self._fs.delete(self._at(f"_versions/{n}"), False)
        return gone
