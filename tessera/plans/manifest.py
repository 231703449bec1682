"""Snapshots of all tables, published together.

Plain Parquet has no transactions, so a version of the store is a manifest: a
small JSON file that names the folders of each table. Tables are written first;
publishing gives the next manifest its name, which only one writer can do. A
reader pins one version, and everything it reads is of that version, whatever
is published meanwhile. Rows that are only added go to a folder of their own
beside those of the versions before, so an append costs what it adds.

The file system calls go through Hadoop, so the store may lie wherever Spark reads.
"""

from __future__ import annotations

import json
import os
import uuid
from collections.abc import Iterable, Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import errors

#: A table of so many folders is written as one at its next append.
MOST_FOLDERS = 64


class Store:
    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
        self._path = lambda p: jvm.org.apache.hadoop.fs.Path(p)
        self._fs = self._path(self.root).getFileSystem(conf)
        self._fs.mkdirs(self._path(f"{self.root}/manifests"))

    # --- manifests -------------------------------------------------------------------

    def _manifest(self, version: int) -> str:
        return f"{self.root}/manifests/{version:012d}.json"

    def latest(self) -> int:
        """The newest version; 0 if nothing is published."""
        names = [s.getPath().getName() for s in self._fs.listStatus(self._path(f"{self.root}/manifests"))]
        return max([0, *(int(n[:12]) for n in names if n.endswith(".json"))])

    def _read(self, version: int) -> dict:
        if version == 0:
            return {"version": 0, "tables": {}, "control": {}}
        stream = self._fs.open(self._path(self._manifest(version)))
        try:
            return json.loads(self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def pin(self, version: int | None = None) -> Snapshot:
        return Snapshot(self, self._read(self.latest() if version is None else version))

    def _write(self, name: str, version: int, df: DataFrame) -> str:
        folder = f"{self.root}/tables/{name}/{version:012d}-{uuid.uuid4().hex}"
        df.write.parquet(folder)
        return folder

    def publish(self, base: Snapshot, tables: Mapping[str, DataFrame], control: Mapping | None = None, appends: Mapping[str, DataFrame] | None = None) -> Snapshot:
        """The next version: ``base`` with these tables in place of its own, and the rows of ``appends`` added to its tables.

        Appended rows take the columns and types of their table; columns they
        lack are null, and nothing is written where there are no rows. Fails if
        another writer has published since ``base``; its tables are then left
        unreferenced and nothing of them is seen.
        """
        version = base.version + 1
        if self.latest() >= version:
            raise errors.ManifestConflictError(f"version {version} is published already")
        folders = dict(base.folders)
        for name, df in tables.items():
            folders[name] = [self._write(name, version, df)]
        for name, df in (appends or {}).items():
            if df.isEmpty():
                continue
            table = base[name]
            rows = df.select(*[(F.col(f"`{f.name}`") if f.name in df.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in table.schema])
            if len(folders[name]) < MOST_FOLDERS:
                folders[name] = [*folders[name], self._write(name, version, rows)]
            else:
                folders[name] = [self._write(name, version, table.unionByName(rows))]
        body = json.dumps({"version": version, "tables": folders, "control": dict(control if control is not None else base.control)})
        aside = f"{self.root}/manifests/{uuid.uuid4().hex}.aside"
        out = self._fs.create(self._path(aside), False)
        out.write(bytearray(body.encode()))
        out.close()
        try:
            self._place(aside, self._manifest(version))
        except Exception as error:
            raise errors.ManifestConflictError(f"version {version} is published already") from error
        finally:
            self._fs.delete(self._path(aside), False)
        return self.pin(version)

    def _place(self, aside: str, name: str) -> None:
        """Gives a whole file its name, if nothing has that name: one writer wins, and no reader sees half a manifest.

        Hadoop's rename decides that in the file system, but not in a local one; there a link does.
        """
        if self._fs.getUri().getScheme() == "file":
            files = [self._fs.makeQualified(self._path(p)).toUri().getPath() for p in (aside, name)]
            os.link(*files)
            return
        jvm = self.spark._jvm.org.apache.hadoop.fs
        context = jvm.FileContext.getFileContext(self._fs.getUri(), self.spark._jsc.hadoopConfiguration())
        options = self.spark.sparkContext._gateway.new_array(jvm.Options.Rename, 0)
        context.rename(self._path(aside), self._path(name), options)

    def address(self, name: str) -> str:
        """A folder of the store for readers outside Hadoop: a path if the store is mounted, else with its scheme."""
        uri = self._fs.makeQualified(self._path(f"{self.root}/{name}")).toUri()
        return uri.getPath() if uri.getScheme() == "file" else uri.toString()

    def has(self, path: str) -> bool:
        return self._fs.exists(self._path(path))

    def discard(self, folder: str) -> None:
        """Deletes a folder that no manifest names."""
        self._fs.delete(self._path(folder), True)

    # --- backup and checks -----------------------------------------------------------

    def backup(self, to: str, blobs: DataFrame | None = None) -> None:
        """A copy of the pinned tables (and blobs); the marker of completeness comes last."""
        snapshot = self.pin()
        for name in snapshot.folders:
            snapshot[name].write.parquet(f"{to}/tables/{name}")
        if blobs is not None:
            blobs.write.parquet(f"{to}/blobs")
        out = self._fs.create(self._path(f"{to}/COMPLETE.json"), False)
        out.write(bytearray(json.dumps({"version": snapshot.version, "tables": sorted(snapshot.folders)}).encode()))
        out.close()


class Snapshot(Mapping):
    """The tables of one version by name."""

    def __init__(self, store: Store, manifest: dict):
        self.store, self.version, self.control = store, manifest["version"], manifest["control"]
        # a name alone is a table of one folder
        self.folders = {n: [f] if isinstance(f, str) else f for n, f in manifest["tables"].items()}

    def __getitem__(self, name: str) -> DataFrame:
        return self.store.spark.read.parquet(*self.folders[name])

    def __iter__(self):
        return iter(self.folders)

    def __len__(self) -> int:
        return len(self.folders)

    def digest(self, names: Iterable[str] | None = None) -> dict[str, str]:
        """Per table a digest of its rows whatever their order or files."""
        return {n: table_digest(self[n]) for n in sorted(names or self.folders)}


def table_digest(df: DataFrame) -> str:
    """Row count and two order-free sums over row hashes; no rows are gathered."""
    row = F.to_json(F.struct(*[F.col(f"`{c}`") for c in sorted(df.columns)]), {"ignoreNullFields": "false"})
    h = F.sha2(row.cast("binary"), 256)
    part = lambda at: F.conv(F.substring(h, at, 15), 16, 10).cast("decimal(38,0)")
    r = df.agg(F.count(F.lit(1)), F.coalesce(F.sum(part(1)), F.lit(0)), F.coalesce(F.sum(part(16)), F.lit(0)), F.coalesce(F.bit_xor(part(31).cast("bigint")), F.lit(0))).first()
    return ":".join(str(x) for x in r)


def schema_status(snapshot: Snapshot, expected: Mapping[str, str]) -> str:
    """``current`` if all tables have the expected schemas (DDL), ``older`` if some only lack columns, else ``unsupported``."""
    from pyspark.sql.types import StructType

    status = "current"
    for name, ddl in expected.items():
        want = {f.name: f.dataType for f in StructType.fromDDL(ddl)}
        have = {f.name: f.dataType for f in snapshot[name].schema} if name in snapshot else {}
        if any(want.get(n) != t for n, t in have.items()):
            return "unsupported"
        if have.keys() != want.keys():
            status = "older"
    return status


def upgrade(store: Store, expected: Mapping[str, str]) -> Snapshot:
    """Publishes a version with the columns that are missing (as nulls); all data must digest as before."""
    from pyspark.sql.types import StructType

    base = store.pin()
    if schema_status(base, expected) == "unsupported":
        raise errors.StoreError("the store has another structure")
    out = {}
    for name, ddl in expected.items():
        want = StructType.fromDDL(ddl)
        if name not in base:
            out[name] = store.spark.createDataFrame([], want)
        elif missing := [f for f in want if f.name not in base[name].columns]:
            wide = base[name].select("*", *[F.lit(None).cast(f.dataType).alias(f.name) for f in missing])
            if table_digest(wide.select(*base[name].columns)) != table_digest(base[name]):
                raise errors.StoreError(f"{name} would change")
            out[name] = wide.select(*[f.name for f in want])
    return store.publish(base, out) if out else base
