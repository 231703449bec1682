"""Small helpers that the operators of this subpackage share.

Conventions that hold for every operator here, unless its docstring says more:

* a null text counts as an empty text;
* a null ``doc_id`` is a value like any other: its row is kept, and where a
  rule hashes the id the null hashes like the empty string;
* repeated rows stay repeated, and get equal results;
* columns beside those an operator names pass through untouched, and a result
  column that an input column already has the name of replaces it.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Texts are handed to numpy in runs of about this many bytes.
CHUNK_BYTES = 4 << 20
#: Arrow batches of this size bound what a task holds beside its results, in the JVM and in Python.
BATCH_CONF, BATCH_DEFAULT, BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch", 64 << 20, "4m"


def small_batches(spark: SparkSession | None) -> None:
    """Lowers the session's bound of Arrow batches, unless someone has set it: long texts would fill 64 MB in every task."""
    if spark is not None and spark.conf.get(BATCH_CONF).lower().rstrip("b") == str(BATCH_DEFAULT):
        spark.conf.set(BATCH_CONF, BATCH_BYTES)


#: Bytes of a row group of tables written between steps, which a task holds while it writes.
ROW_GROUP = 32 << 20


def text_bytes(texts: pa.Array) -> list[bytes]:
    """The UTF-8 of each text; nulls are empty."""
    return [b"" if v is None else v for v in texts.cast(pa.binary()).to_pylist()]


def text_strs(texts: pa.Array) -> list[str]:
    return ["" if v is None else v for v in texts.to_pylist()]


def chunks(texts: pa.Array, most: int = CHUNK_BYTES) -> Iterator[pa.Array]:
    """Slices of at most ``most`` bytes, or of one text that is longer."""
    import pyarrow.compute as pc

    ends = np.cumsum(pc.binary_length(texts).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64))
    start, before = 0, 0
    while start < len(ends):
        stop = max(start + 1, int(np.searchsorted(ends, before + most, side="right")))
        yield texts.slice(start, stop - start)
        start, before = stop, int(ends[stop - 1])


def text_udf(fn: Callable[[pa.Array], dict[str, pa.Array]], schema: dict[str, str]) -> Callable[[Column], Column]:
    """An Arrow UDF from texts to a struct.

    ``fn`` gets a bounded slice of texts and returns one array per field. It is
    declared non-deterministic only so that Catalyst never evaluates it twice
    for a filter and a projection over the same column.
    """
    names = list(schema)
    small_batches(SparkSession.getActiveSession())

    def run(texts: pa.Array) -> pa.Array:
        parts = []
        for part in chunks(texts):
            got = fn(part)
            parts.append(pa.StructArray.from_arrays([got[n] for n in names], names))
        if not parts:
            got = fn(texts)
            return pa.StructArray.from_arrays([got[n] for n in names], names)
        return pa.concat_arrays(parts)

    def wrapped(texts):
        return run(texts)

    wrapped.__annotations__ = {"texts": pa.Array, "return": pa.Array}
    return F.arrow_udf(wrapped, ", ".join(f"`{n}`: {t}" for n, t in schema.items())).asNondeterministic()


def crc_mod(id_column: str | Column, modulus: int) -> Column:
    """crc32 of the id as text, modulo ``modulus``."""
    c = F.col(id_column) if isinstance(id_column, str) else id_column
    return F.pmod(F.crc32(F.coalesce(c.cast("string"), F.lit("")).cast("binary")), F.lit(modulus))


def free_name(df: DataFrame, name: str) -> str:
    """``name``, lengthened until no column of ``df`` has it."""
    have = {c.lower() for c in df.columns}
    while name.lower() in have:
        name += "_"
    return name


def with_struct(df: DataFrame, made: Column, fields: list[str]) -> DataFrame:
    """``df`` with the fields of the struct ``made`` as columns; an equally named column of ``df`` gives way."""
    tmp = free_name(df, "made")
    taken = {f.lower() for f in fields}
    keep = [f"`{c}`" for c in df.columns if c.lower() not in taken]
    return df.withColumn(tmp, made).select(*keep, *[F.col(tmp)[f].alias(f) for f in fields])


def shared_folder(spark: SparkSession) -> str:
    """The session's checkpoint folder, which all executors share.

    It is the cluster's ``spark.checkpoint.dir``; one is set here only where the
    session has none, as in local tests.
    """
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        told = sc.getConf().get("spark.checkpoint.dir")
        if told is None:
            if not sc.master.startswith("local["):
                raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
            import tempfile

            told = tempfile.mkdtemp(prefix="checkpoint-")
        sc.setCheckpointDir(told)
    return sc.getCheckpointDir()


def checkpoint(df: DataFrame) -> DataFrame:
    """Cuts the lineage through the shared folder."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as Parquet in the shared folder, read again."""
    path = f"{shared_folder(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.option("parquet.block.size", ROW_GROUP).parquet(path)
    return df.sparkSession.read.parquet(path)


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
