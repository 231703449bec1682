"""A folder as a source: enumeration as a data source of Spark, and guarded reads of its files.

``spark.dataSource.register(FolderSource)`` once, then
``spark.read.format("folder").option("path", root).load()``. Every problem of
an entry is a row: enumeration itself never throws for what it meets.
"""

from __future__ import annotations

import errno
import hashlib
import math
import os
import stat
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..functions import errors
from ..functions.identity import canonical_config_hash

ITEM_SCHEMA = (
    "enum_seq bigint, kind string, stable_key string, subtree_key string, error_kind string, entry_kind string, reason string, link_count bigint, size_bytes bigint, modified_at bigint, quick_fingerprint string"
)
LOCK_PREFIX = "~$"


def name_rejection(name: str, windows: bool = False) -> str | None:
    """Why a name can't be a key: what was undecodable comes first, then separators, then what one system reserves."""
    if "\ufffd" in name or any("\udc80" <= c <= "\udcff" for c in name):
        return "replacement_character"
    if "\0" in name or "\\" in name:
        return "separator_or_nul"
    if windows and any(ord(c) < 32 or c == ":" for c in name):
        return "reserved_character"
    return None


def rejection_column(name: Column, windows: bool = False) -> Column:
    out = F.when(name.contains("\ufffd"), "replacement_character").when(name.contains("\0") | name.contains("\\"), "separator_or_nul")
    return out.when(name.rlike("[\\x00-\\x1f:]"), "reserved_character") if windows else out


def entry_kind(mode: int) -> str:
    for test, kind in (
        (stat.S_ISLNK, "symlink"), (stat.S_ISDIR, "directory"), (stat.S_ISREG, "file"), (stat.S_ISFIFO, "fifo"), (stat.S_ISSOCK, "socket"), (stat.S_ISCHR, "character_device"), (stat.S_ISBLK, "block_device"),
    ):
        if test(mode):
            return kind
    return "unknown"


def fingerprint(mtime_ms: float, size: int) -> str:
    """A weak mark of a file's state: whole milliseconds (cut off, not rounded) and size."""
    return f"{math.trunc(mtime_ms)}:{size}"


def fingerprint_column(mtime_ms: Column, size: Column) -> Column:
    whole = F.when(mtime_ms < 0, F.ceil(mtime_ms)).otherwise(F.floor(mtime_ms)).cast("bigint")
    return F.concat_ws(":", whole.cast("string"), size.cast("string"))


def is_lock_file(name: str) -> bool:
    return name.startswith(LOCK_PREFIX)


def error_name(error: OSError) -> str:
    return errno.errorcode.get(error.errno or 0, type(error).__name__)


_COLUMNS = ("kind", "stable_key", "subtree_key", "error_kind", "entry_kind", "reason", "link_count", "size_bytes", "modified_at", "quick_fingerprint")


def walk(root: str, start: str = "", windows: bool = os.name == "nt", deep: bool = True) -> Iterator[dict]:
    """The items below ``start``, depth first; links aren't followed. Not ``deep``: folders are items to walk later (kind ``folder``)."""
    pending = [start]
    while pending:
        folder = pending.pop()
        try:
            with os.scandir(os.path.join(root, folder) if folder else root) as listing:
                names = sorted((e.name, e.is_file(follow_symlinks=False) or e.is_symlink()) for e in listing)
        except OSError as error:
            yield {"kind": "unlistable_subtree", "subtree_key": folder or ".", "error_kind": error_name(error)}
            continue
        below = []
        for name, is_leaf in names:
            key = f"{folder}/{name}" if folder else name
            refused = name_rejection(name, windows)
            if refused:
                yield {"kind": "unusable_name", "stable_key": key.encode("utf-8", "replace").decode(), "reason": refused}
                continue
            try:
                info = os.lstat(os.path.join(root, key))
            except OSError as error:
                # what isn't known to be a leaf may be a folder: then all below it is unseen
                yield {"kind": "vanished_during_scan", "stable_key": key} if is_leaf else {"kind": "unlistable_subtree", "subtree_key": key, "error_kind": error_name(error)}
                continue
            kind = entry_kind(info.st_mode)
            if kind == "directory":
                if deep:
                    below.append(key)
                else:
                    yield {"kind": "folder", "subtree_key": key}
            elif kind != "file":
                yield {"kind": "not_a_regular_file", "stable_key": key, "entry_kind": kind}
            elif is_lock_file(name):
                yield {"kind": "office_temporary_file", "stable_key": key}
            elif info.st_nlink > 1:
                yield {"kind": "hard_linked", "stable_key": key, "link_count": info.st_nlink}
            else:
                ms = info.st_mtime_ns / 1e6
                yield {"kind": "entry", "stable_key": key, "size_bytes": info.st_size, "modified_at": math.trunc(ms), "quick_fingerprint": fingerprint(ms, info.st_size)}
        pending += reversed(below)


@dataclass
class _Part(InputPartition):
    number: int
    folders: tuple[str, ...]
    items: tuple[dict, ...] = ()


class _Reader(DataSourceReader):
    """The top level is listed once; each folder in it is a partition of its own, walked where the task runs."""

    def __init__(self, root: str):
        self.root = root

    def partitions(self) -> list[InputPartition]:
        top = list(walk(self.root, deep=False))
        folders = [i["subtree_key"] for i in top if i["kind"] == "folder"]
        here = tuple(i for i in top if i["kind"] != "folder")
        return [_Part(0, (), here), *(_Part(k + 1, (f,)) for k, f in enumerate(folders))]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        seq = partition.number << 40  # partitions in order, entries in order within them
        for item in (*partition.items, *(i for f in partition.folders for i in walk(self.root, f))):
            yield (seq, *(item.get(c) for c in _COLUMNS))
            seq += 1


class FolderSource(DataSource):
    """``path``: an absolute folder that every executor sees."""

    @classmethod
    def name(cls) -> str:
        return "folder"

    def schema(self) -> str:
        return ITEM_SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options["path"])


def enumerate_folder(spark: SparkSession, root: str, source_id: str) -> DataFrame:
    spark.dataSource.register(FolderSource)
    return spark.read.format("folder").option("path", root).load().withColumn("source_id", F.lit(source_id))


# --- reading files -----------------------------------------------------------------------


class ContainmentError(ValueError):
    pass


def safe_path(root: str, key: str) -> str:
    """The path of a key, or an error if the key could lead anywhere but to that plain file below the root."""
    parts = key.split("/")
    if not key or key.startswith("/") or any(p in ("", ".", "..") for p in parts) or "\0" in key or "\\" in key:
        raise ContainmentError("malformed key")
    base = os.path.realpath(root)
    path = os.path.join(base, *parts)
    if os.path.realpath(path) != path:
        raise ContainmentError("the key leads through a link or has another case")
    info = os.lstat(path)
    if not stat.S_ISREG(info.st_mode):
        raise ContainmentError("not a regular file")
    if info.st_nlink > 1:
        raise ContainmentError("hard-linked")
    return path


OUTCOME = "struct<kind:string,content_hash:string,size_bytes:bigint,error_kind:string,declared_size_bytes:bigint,actual_size_bytes:bigint>"
_OUTCOME_TYPE = pa.struct([("kind", pa.string()), ("content_hash", pa.string()), ("size_bytes", pa.int64()), ("error_kind", pa.string()), ("declared_size_bytes", pa.int64()), ("actual_size_bytes", pa.int64())])


def read_outcome(root: str, key: str, declared: int | None, put=None, restore=None) -> dict:
    """Reads a file and says what came of it. ``put`` stores the bytes and returns their hash.

    Other bytes under their address stop the scan: the entry would pass for
    read. With ``restore`` (key, bytes, size) the file is read once more instead
    and takes that place, if it still is what the address says.
    """
    none = dict.fromkeys(("kind", "content_hash", "size_bytes", "error_kind", "declared_size_bytes", "actual_size_bytes"))
    try:
        data = _bytes(root, key)
        if declared is not None and len(data) != declared:
            return none | {"kind": "size_mismatch", "declared_size_bytes": declared, "actual_size_bytes": len(data)}
        try:
            digest = put(data) if put else hashlib.sha256(data).hexdigest()
        except errors.BlobDivergenceError as error:
            address = error.facts.get("key")
            if restore is None or address is None:
                raise
            data = _bytes(root, key)
            digest = restore(address, data, len(data) if declared is None else declared)
        return none | {"kind": "content", "content_hash": digest, "size_bytes": len(data)}
    except errors.BlobDivergenceError:
        raise
    except ContainmentError as error:
        return none | {"kind": "unreadable", "error_kind": f"containment:{error}"}
    except OSError as error:
        return none | {"kind": "unreadable", "error_kind": error_name(error)}
    except Exception as error:  # noqa: BLE001  whatever else keeps an entry from being read is its outcome
        return none | {"kind": "unreadable", "error_kind": str(errors.kind_of(error))}


def _bytes(root: str, key: str) -> bytes:
    with open(safe_path(root, key), "rb") as f:
        return f.read()


def with_outcomes(items: DataFrame, root: str, blob_root: str | None = None, *, repair: bool = False) -> DataFrame:
    """``items`` with ``outcome`` for its entries; contents go to the blob folder, if one is named, where ``repair`` puts torn blobs right."""
    from .blobs import BlobStore

    def run(kinds: pa.Array, keys: pa.Array, sizes: pa.Array) -> pa.Array:
        store = BlobStore(blob_root) if blob_root else None
        put, restore = (store.put_bytes, store.restore if repair else None) if store else (None, None)
        rows = [read_outcome(root, k, s, put, restore) if kind == "entry" else None for kind, k, s in zip(kinds.to_pylist(), keys.to_pylist(), sizes.to_pylist())]
        return pa.array(rows, _OUTCOME_TYPE)

    run.__annotations__ = {"kinds": pa.Array, "keys": pa.Array, "sizes": pa.Array, "return": pa.Array}
    return items.withColumn("outcome", F.arrow_udf(run, OUTCOME)("kind", "stable_key", "size_bytes"))


def register_source(sources: DataFrame, root: str, name: str | None = None, data_dir: str | None = None) -> tuple[str, DataFrame]:
    """(source id, sources after): registering a folder again changes nothing."""
    if not os.path.isabs(root):
        raise ValueError("the folder must be an absolute path")
    real = os.path.realpath(root)
    if not os.path.isdir(real):
        raise ValueError("not a folder")
    if data_dir is not None and "://" not in data_dir:
        data = os.path.realpath(data_dir)
        if os.path.commonpath([data, real]) in (data, real):
            raise ValueError("the folder and the store overlap")
    config = canonical_config_hash({"root": real})
    source_id = hashlib.sha256(f"operator-local:{config}".encode()).hexdigest()
    row = [(source_id, "local-fs", config, (name or "").strip() or os.path.basename(real), "NFC", False, "posix", True)]
    schema = "source_id string, kind string, config_hash string, display_name string, key_unicode_form string, key_case_fold boolean, key_path_separator string, key_trim_slashes boolean"
    new = sources.sparkSession.createDataFrame(row, schema).join(sources.select("source_id"), "source_id", "left_anti")
    return source_id, sources.unionByName(new, allowMissingColumns=True)
