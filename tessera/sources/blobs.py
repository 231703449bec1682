"""Content-addressed blobs: a folder that all executors share, and checks of what it holds as set operations."""

from __future__ import annotations

import hashlib
import os
import uuid
from typing import BinaryIO

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import errors
from ..functions.identity import HEX


def blob_path(root: str, key: str) -> str:
    if len(key) < 3 or not HEX.fullmatch(key):
        raise ValueError("malformed blob key")
    return os.path.join(root, key[:2], key[2:])


def _digest_of(file: BinaryIO) -> str:
    h = hashlib.sha256()
    with file as f:
        while piece := f.read(1 << 20):
            h.update(piece)
    return h.hexdigest()


def _sync(path: str) -> None:
    fd = os.open(path, os.O_RDONLY)
    try:
        os.fsync(fd)
    finally:
        os.close(fd)


class _Mounted:
    """Files below a path that executors mount."""

    def exists(self, path: str) -> bool:
        return os.path.exists(path)

    def read(self, path: str) -> BinaryIO:
        return open(path, "rb")

    def write(self, path: str, data: bytes) -> None:
        os.makedirs(os.path.dirname(path), exist_ok=True)
        with open(path, "xb") as f:
            f.write(data)
            f.flush()
            os.fsync(f.fileno())

    def move(self, old: str, new: str) -> None:
        os.makedirs(os.path.dirname(new), exist_ok=True)
        os.replace(old, new)
        _sync(os.path.dirname(new))

    def delete(self, path: str) -> None:
        os.unlink(path)


class _Remote:
    """Files of a store with a scheme (``hdfs://``, ``s3://`` ...), as Arrow reaches it from a task."""

    def __init__(self, root: str):
        self.fs, inner = fs.FileSystem.from_uri(root)
        self.inner = lambda path: inner.rstrip("/") + path[len(root) :]

    def exists(self, path: str) -> bool:
        return self.fs.get_file_info(self.inner(path)).type == fs.FileType.File

    def read(self, path: str) -> BinaryIO:
        if not self.exists(path):
            raise FileNotFoundError(path)
        return self.fs.open_input_stream(self.inner(path))

    def write(self, path: str, data: bytes) -> None:
        self.fs.create_dir(os.path.dirname(self.inner(path)), recursive=True)
        with self.fs.open_output_stream(self.inner(path)) as f:
            f.write(data)

    def move(self, old: str, new: str) -> None:
        self.fs.create_dir(os.path.dirname(self.inner(new)), recursive=True)
        if self.exists(new):  # some stores don't move over a file
            self.fs.delete_file(self.inner(new))
        self.fs.move(self.inner(old), self.inner(new))

    def delete(self, path: str) -> None:
        self.fs.delete_file(self.inner(path))


class BlobStore:
    """Writes are idempotent, so a task that runs again does no harm. The root is a path or has a scheme."""

    def __init__(self, root: str):
        self.root = root.rstrip("/") or root
        self.files = _Remote(self.root) if "://" in root else _Mounted()

    def put(self, data: bytes, expected_size: int | None = None, key: str | None = None, *, restore: bool = False) -> tuple[str, bool]:
        """(key, created). Bytes are written aside, read back and hashed, and only then take their name.

        Other bytes under the name are an error, or are replaced if this is a restore.
        """
        if expected_size is not None and len(data) != expected_size:
            raise errors.SizeMismatchError(declared=expected_size, actual=len(data))
        aside = os.path.join(self.root, "tmp", uuid.uuid4().hex)
        try:
            self.files.write(aside, data)
            digest = _digest_of(self.files.read(aside))
            if key is not None and key != digest:
                raise errors.BlobDivergenceError(key=key, actual=digest)
            path = blob_path(self.root, digest)
            if self.files.exists(path) and not restore:
                if _digest_of(self.files.read(path)) != digest:
                    raise errors.BlobDivergenceError(key=digest)
                return digest, False
            self.files.move(aside, path)
            return digest, True
        finally:
            if self.files.exists(aside):
                self.files.delete(aside)

    def put_bytes(self, data: bytes) -> str:
        return self.put(data)[0]

    def restore(self, key: str, data: bytes, size: int) -> str:
        return self.put(data, size, key, restore=True)[0]

    def verify(self, key: str, content_hash: str) -> bool:
        """Whether the bytes are there and hash to this; a missing blob is no error."""
        path = blob_path(self.root, key)
        return self.files.exists(path) and _digest_of(self.files.read(path)) == content_hash

    def get(self, key: str, content_hash: str) -> bytes:
        data = self.get_unverified(key)
        if hashlib.sha256(data).hexdigest() != content_hash:
            raise errors.BlobDivergenceError(key=key)
        return data

    def get_unverified(self, key: str) -> bytes:
        """For repair alone."""
        with self.files.read(blob_path(self.root, key)) as f:
            return f.read()

    def delete(self, key: str) -> None:
        raise NotImplementedError("blobs are never deleted")


def stored_blobs(spark: SparkSession, root: str) -> DataFrame:
    """(blob_key, content) of every stored blob, read by Spark from whatever store holds the folder."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    tail = F.slice(F.split("path", "/"), -2, 2)
    return files.where(F.col("path").rlike("/[0-9a-f]{2}/[0-9a-f]+$")).select(F.array_join(tail, "").alias("blob_key"), "content")


def blob_column(root: str, key: Column, content_hash: Column) -> Column:
    """The bytes under a key, read by the task that has the row; null if they are missing or hash to something else."""

    def run(keys: pa.Array, hashes: pa.Array) -> pa.Array:
        store, out = BlobStore(root), []
        for k, h in zip(keys.to_pylist(), hashes.to_pylist()):
            try:
                out.append(store.get(k, h) if k and h else None)
            except (OSError, ValueError, errors.BlobDivergenceError):
                out.append(None)
        return pa.array(out, pa.large_binary())

    run.__annotations__ = {"keys": pa.Array, "hashes": pa.Array, "return": pa.Array}
    return F.arrow_udf(run, "binary")(key, content_hash)


def verify_references(references: DataFrame, blobs: DataFrame) -> DataFrame:
    """``references`` (blob_key, content_hash, ...) with ``verified``: the bytes are there and hash to it."""
    have = blobs.select("blob_key", F.sha2("content", 256).alias("actual_hash"))
    return references.join(have, "blob_key", "left").withColumn("verified", F.coalesce(F.col("actual_hash") == F.col("content_hash"), F.lit(False)))


def verified_content(content: Column, content_hash: Column) -> Column:
    """The bytes, or an error where they don't hash to what they should."""
    return F.when(F.sha2(content, 256) == content_hash, content).otherwise(F.raise_error(F.lit("content doesn't match its hash")).cast("binary"))
