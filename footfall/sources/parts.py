"""A table in parts (days, buckets) whose states change as a whole: files are written first, then a manifest names them.

``data/v=<token>/<part column>=<value>/`` holds files that never change; ``manifests/<number>.json`` lists, for every part, the
folders that make it up, and for every writer the number of its last batch. Readers go by the newest manifest, so they
see the table before or after a change and nothing between; what a failed writer left is in no manifest. A manifest is
published by a rename that fails if its number is taken, so two writers cannot both be next. (On a store without
such a rename, one writer at a time.) Manifests grow with the number of parts and of their folders, not with the batches.
"""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Callable, Iterable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


@dataclass
class Manifest:
    number: int = -1
    schema: str = ""
    parts: dict[str, list[str]] = field(default_factory=dict)
    marks: dict[str, int] = field(default_factory=dict)


class PartTable:
    def __init__(self, spark: SparkSession, root: str, part: str = "day") -> None:
        self.spark, self.root, self.part = spark, root.rstrip("/"), part
        self._jvm = spark.sparkContext._jvm.org.apache.hadoop.fs
        self._conf = spark.sparkContext._jsc.hadoopConfiguration()

    # ---- files ----------------------------------------------------------------------------------

    def _path(self, *names: str):
        p = self._jvm.Path("/".join([self.root, *names]))
        return p, p.getFileSystem(self._conf)

    def _names(self, *folder: str) -> list[tuple[str, int]]:
        p, fs = self._path(*folder)
        return [(s.getPath().getName(), s.getModificationTime()) for s in fs.listStatus(p)] if fs.exists(p) else []

    def _text(self, name: str) -> str:
        p, fs = self._path("manifests", name)
        with_stream = fs.open(p)
        try:
            return self.spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(with_stream, "UTF-8")
        finally:
            with_stream.close()

    def manifest(self) -> Manifest:
        """The newest state."""
        while True:
            numbers = sorted(n for n, _ in self._names("manifests") if n.endswith(".json"))
            if not numbers:
                return Manifest()
            try:
                return Manifest(int(numbers[-1].split(".")[0]), **json.loads(self._text(numbers[-1])))
            except Exception:  # noqa: BLE001 - it may just have been dropped for a newer one
                if numbers[-1] in {n for n, _ in self._names("manifests")}:
                    raise

    def _publish(self, m: Manifest) -> bool:
        """Makes m the newest state unless another writer has taken its number."""
        temp, fs = self._path("manifests", f"{uuid.uuid4().hex}.tmp")
        out = fs.create(temp, False)
        out.write(bytearray(json.dumps({"schema": m.schema, "parts": m.parts, "marks": m.marks}).encode()))
        out.close()
        final, _ = self._path("manifests", f"{m.number:012d}.json")
        context = self._jvm.FileContext.getFileContext(final.toUri(), self._conf)
        none = self.spark.sparkContext._gateway.new_array(getattr(self._jvm, "Options$Rename"), 0)
        try:
            context.rename(temp, final, none)
        except Exception:  # noqa: BLE001 - told apart by what is there
            if not fs.exists(final):
                raise
            fs.delete(temp, False)
            return False
        return True

    def _commit(self, change: Callable[[Manifest], Manifest | None]) -> bool:
        """Publishes ``change`` of the newest state; once more if another writer was faster. False if there is nothing to change."""
        while True:
            now = self.manifest()
            after = change(Manifest(now.number, now.schema, {k: list(v) for k, v in now.parts.items()}, dict(now.marks)))
            if after is None:
                return False
            after.number = now.number + 1
            if self._publish(after):
                return True

    def _write(self, df: DataFrame) -> tuple[str, list[str]]:
        """New files for the rows of df: their folder and the parts in it."""
        token = uuid.uuid4().hex
        df.hint("rebalance", F.col(self.part)).write.partitionBy(self.part).parquet(f"{self.root}/data/v={token}")
        return token, [n.split("=", 1)[1] for n, _ in self._names("data", f"v={token}") if n.startswith(f"{self.part}=")]

    # ---- use ------------------------------------------------------------------------------------

    def read(self, parts: Iterable[str] | None = None, between: tuple[str, str] | None = None, schema: str | StructType | None = None) -> DataFrame:
        """The rows as they stand, of all parts, of some, or of a range of them (both ends included): only their files are listed."""
        m = self.manifest()
        if not m.schema:
            if schema is None:
                raise ValueError(f"{self.root} is empty; tell its schema")
            return self.spark.createDataFrame([], schema)
        wanted = m.parts.keys() if parts is None else {str(p) for p in parts} & m.parts.keys()
        if between is not None:
            wanted = [p for p in wanted if between[0] <= p <= between[1]]
        kind = StructType.fromJson(json.loads(m.schema))
        paths = [f"{self.root}/data/v={v}/{self.part}={p}" for p in sorted(wanted) for v in m.parts[p]]
        if not paths:
            return self.spark.createDataFrame([], kind)
        return self.spark.read.schema(kind).option("basePath", f"{self.root}/data").parquet(*paths).select(kind.names)

    def replace(self, df: DataFrame, parts: Iterable[str]) -> None:
        """The listed parts become the rows of df; listed parts without rows are empty."""
        listed = [str(p) for p in parts]
        token, made = self._write(df.where(F.col(self.part).cast("string").isin(listed)))

        def change(m: Manifest) -> Manifest:
            m.schema = m.schema or df.schema.json()
            m.parts = {p: v for p, v in m.parts.items() if p not in listed} | {p: [token] for p in made}
            return m

        self._commit(change)

    def append(self, df: DataFrame, writer: str = "", batch: int | None = None) -> bool:
        """Adds rows. With ``batch``, one that ``writer`` has added before, or an older one, is left alone: False."""
        if batch is not None and self.manifest().marks.get(writer, -1) >= batch:
            return False
        token, made = self._write(df)

        def change(m: Manifest) -> Manifest | None:
            if batch is not None:
                if m.marks.get(writer, -1) >= batch:
                    return None
                m.marks[writer] = batch
            m.schema = m.schema or df.schema.json()
            for p in made:
                m.parts.setdefault(p, []).append(token)
            return m

        return self._commit(change)

    def compact(self, merge: Callable[[DataFrame], DataFrame] | None = None, most: int = 1) -> list[str]:
        """Rewrites the parts of more than ``most`` folders as one folder each, ``merge`` applied to their rows; others keep their
        files. Rows that are added meanwhile stay beside. Returns the parts."""
        before = self.manifest()
        todo = {p: v for p, v in before.parts.items() if len(v) > most}
        if not todo:
            return []
        rows = self.read(todo)
        token, made = self._write(rows if merge is None else merge(rows).select(rows.columns))

        def change(m: Manifest) -> Manifest | None:
            for p, old in todo.items():
                now = m.parts.get(p, [])
                if not set(old) <= set(now):
                    return None  # another writer has replaced the part
                m.parts[p] = [token] * (p in made) + [v for v in now if v not in old]
            return m

        return list(todo) if self._commit(change) else []

    def vacuum(self, keep: int = 2, seconds: float = 3600) -> None:
        """Deletes manifests but the newest ``keep``, and folders over ``seconds`` old that none of those names."""
        kept = sorted(n for n, _ in self._names("manifests") if n.endswith(".json"))[-keep:]
        named = {v for n in kept for vs in json.loads(self._text(n))["parts"].values() for v in vs}
        old = (time.time() - seconds) * 1000
        for folder, live in (("manifests", set(kept)), ("data", {f"v={v}" for v in named})):
            for name, changed in self._names(folder):
                if name not in live and changed <= old:
                    p, fs = self._path(folder, name)
                    fs.delete(p, True)
