"""Tables that are replaced as a whole, atomically: a reader sees the snapshot before or the one after, never a part.

Layout of a folder: ``data/<id>/<table>`` (Parquet, written once, never changed) and ``commits/<n>`` (JSON: the id, and each table's rows and schema). A writer stages its
tables under a new id, reads them back and holds their counts against what was counted while they were written, then puts a finished commit file in place under the next number. That
is one rename which fails if the number is taken: a writer that was overtaken is told so (``Conflict``) and starts again from the newer snapshot. A job
that is killed before leaves data that no commit names, and the old snapshot stands; ``expire`` clears such data away.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


class Conflict(RuntimeError):
    """Another writer has committed since the snapshot that this one started from."""


class Snapshots:
    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")
        self.jvm = spark._jvm
        self.conf = spark._jsc.hadoopConfiguration()

    def _path(self, *parts: str):
        return self.jvm.org.apache.hadoop.fs.Path("/".join([self.folder, *parts]))

    def _files(self):
        return self._path().getFileSystem(self.conf)

    def version(self) -> int:
        """The number of the newest commit; 0 if there is none."""
        files, at = self._files(), self._path("commits")
        if not files.exists(at):
            return 0
        names = [s.getPath().getName() for s in files.listStatus(at)]
        return max((int(n) for n in names if n.isdigit()), default=0)

    def commit(self, version: int) -> dict:
        stream = self._files().open(self._path("commits", str(version)))
        try:
            return json.loads(bytes(stream.readAllBytes()).decode())
        finally:
            stream.close()

    def read(self, table: str, version: int | None = None) -> DataFrame | None:
        """A table of a snapshot (the newest, or one that is asked for); None if it isn't there."""
        version = self.version() if version is None else version
        held = self.commit(version)["tables"].get(table) if version else None
        return None if held is None else self.spark.read.schema(StructType.fromJson(held["schema"])).parquet(f"{self.folder}/{held['path']}")

    def replace(self, tables: dict[str, DataFrame], base: int | None = None) -> int:
        """A new snapshot with these tables in place of those of the same names; others stay. ``base`` is the version that they were made from."""
        base = self.version() if base is None else base
        ident, held = uuid.uuid4().hex, dict(self.commit(base)["tables"]) if base else {}
        for name, df in tables.items():
            path = f"data/{ident}/{name}"
            held[name] = {"path": path, "rows": self._staged(df, f"{self.folder}/{path}"), "schema": df.schema.jsonValue()}
        self._switch(base + 1, json.dumps({"id": ident, "tables": held}))
        return base + 1

    def _staged(self, df: DataFrame, path: str) -> int:
        """Writes df and returns its rows; fails if what is read back are not as many as were written."""
        from pyspark.sql import Observation

        seen = Observation()
        df.observe(seen, F.count(F.lit(1)).alias("rows")).write.parquet(path)
        written, found = seen.get["rows"], self.spark.read.schema(df.schema).parquet(path).count()
        if written != found:
            raise RuntimeError(f"{path} holds {found} rows of {written}")
        return found

    def _switch(self, version: int, text: str) -> None:
        files, staged = self._files(), self._path("commits", f"_{uuid.uuid4().hex}")
        stream = files.create(staged)
        stream.write(bytearray(text.encode()))
        stream.close()
        context = self.jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._path().toUri(), self.conf)
        none = self.spark.sparkContext._gateway.new_array(self.jvm.org.apache.hadoop.fs.Options.Rename, 0)
        try:
            context.rename(staged, self._path("commits", str(version)), none)
        except Exception as failed:
            files.delete(staged, False)
            if "FileAlreadyExists" in str(failed):
                raise Conflict(f"version {version} of {self.folder} has been committed by another writer") from failed
            raise

    def update(self, change: Callable[[dict[str, DataFrame]], dict[str, DataFrame]], attempts: int = 5) -> int:
        """change(tables of the newest snapshot) put in place; begun again from the newer one where another writer was faster."""
        for left in reversed(range(attempts)):
            base = self.version()
            names = self.commit(base)["tables"] if base else {}
            try:
                return self.replace(change({n: self.read(n, base) for n in names}), base)
            except Conflict:
                if not left:
                    raise
        raise AssertionError

    def replace_where(self, table: str, goes: Column, rows: DataFrame, attempts: int = 5) -> int:
        """The table without the rows for which ``goes`` holds, and with ``rows``: a window or a source replaced at once."""

        def change(tables: dict[str, DataFrame]) -> dict[str, DataFrame]:
            held = tables.get(table)
            return {table: rows if held is None else held.where(~F.coalesce(goes, F.lit(False))).unionByName(rows)}

        return self.update(change, attempts)

    def expire(self, keep: int = 2) -> int:
        """Drops all but the newest ``keep`` commits and the data that no kept one names; returns how many data folders went.

        Not to be run beside writers: what they are staging isn't named yet.
        """
        files, last = self._files(), self.version()
        if not last:
            return 0
        used = {held["path"].split("/")[1] for v in range(max(1, last - keep + 1), last + 1) for held in self.commit(v)["tables"].values()}
        for status in files.listStatus(self._path("commits")):
            name = status.getPath().getName()
            if not name.isdigit() or int(name) <= last - keep:
                files.delete(status.getPath(), False)
        gone = [s.getPath() for s in files.listStatus(self._path("data")) if s.getPath().getName() not in used]
        for path in gone:
            files.delete(path, True)
        return len(gone)
