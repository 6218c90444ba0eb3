"""What the operators share: the shared folder, Arrow batches, tables, checkpoints."""

from __future__ import annotations

import ctypes
import os
import re
import tempfile
import uuid
from collections.abc import Callable, Iterator
from pathlib import Path
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

#: Rows turned into Python objects at a time; Arrow batches hold 64 MB at most by Spark's own setting.
SLICE = 256


def importable(spark: SparkSession) -> None:
    """Let Python workers of a local session import this package even if only the driver's path has it."""
    root = str(Path(__file__).resolve().parents[2])
    env = spark.sparkContext.environment
    if root not in env.get("PYTHONPATH", "").split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(x for x in (root, env.get("PYTHONPATH", "")) if x)


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    Where a session has none, a local master (tests on one machine) gets one of its own; a cluster is refused, as executors
    see no folder of the driver's machine.
    """
    jsc = spark.sparkContext._jsc.sc()
    if jsc.getCheckpointDir().isEmpty():
        conf = spark.conf.get("spark.checkpoint.dir", None)
        if not conf and not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        spark.sparkContext.setCheckpointDir(conf or tempfile.mkdtemp(prefix="pactframe-"))
    return str(jsc.getCheckpointDir().get())


def fresh_dir(spark: SparkSession, name: str) -> str:
    """A new path (not yet a folder) below the shared one."""
    return f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex[:12]}"


def cut(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared folder and go on from there, so that lost executors cost little."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def saved(df: DataFrame) -> DataFrame:
    """Write ``df`` as compressed columns to the shared folder and read them back: like ``cut``, for larger tables."""
    path = fresh_dir(df.sparkSession, "table")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def release() -> None:
    """Give memory that freed batches and texts have left behind back to the system. Workers live on from stage to stage, and the allocators would keep it."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc's
    if trim:
        trim(0)


def map_rows(df: DataFrame, fn: Callable[[Iterator[dict[str, list]]], Iterator[dict[str, Any]]], schema: str) -> DataFrame:
    """``mapInArrow`` over small column slices: ``fn`` gets an iterator of {column: list} for a whole
    partition and yields {column: list} in turn."""
    from pyspark.sql.types import _parse_datatype_string
    from pyspark.sql.pandas.types import to_arrow_schema

    importable(df.sparkSession)
    arrow = to_arrow_schema(_parse_datatype_string(schema))

    def slices(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, SLICE):
                part = batch.slice(at, SLICE)
                yield {n: part.column(i).to_pylist() for i, n in enumerate(part.schema.names)}
            batch = part = None
            release()

    def run(batches):
        for out in fn(slices(batches)):
            yield pa.RecordBatch.from_arrays([pa.array(out[f.name], type=f.type) for f in arrow], schema=arrow)

    return df.mapInArrow(run, schema)


def fresh_name(df: DataFrame, name: str) -> str:
    """``name``, with underscores until no column of ``df`` is called so (in any case)."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def extend(df: DataFrame, text_col: str, fn: Callable[[list[str | None]], list[dict[str, Any]]], schema: str, name: str) -> DataFrame:
    """``df`` as it is and a struct column ``name`` with what ``fn`` makes of the texts, a slice at a time."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType, _parse_datatype_string

    importable(df.sparkSession)
    made = _parse_datatype_string(schema)
    kind = to_arrow_schema(StructType().add(name, made)).field(0)
    at = df.columns.index(text_col)

    def run(batches):
        for batch in batches:
            for i in range(0, batch.num_rows, SLICE):
                part = batch.slice(i, SLICE)
                out = pa.array(fn(part.column(at).to_pylist()), type=kind.type)
                yield pa.RecordBatch.from_arrays([*part.columns, out], names=[*part.schema.names, name])
            batch = part = out = None
            release()

    return df.mapInArrow(run, StructType([*df.schema.fields]).add(name, made))
