"""What the operators of this subpackage share: reading tables, the shared folder, whole-batch Python stages."""

from __future__ import annotations

import os
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..storage import saved, shared_dir

#: Words of the near-duplicate, leak, quality, packing and classifier operators: runs of anything but ASCII white space.
SPACE = r"[\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fresh_dir(spark: SparkSession, tag: str) -> str:
    return f"{shared_dir(spark)}/{tag}-{uuid.uuid4().hex}"


def by_batch(df: DataFrame, make: Callable[[], Callable[[dict[str, list]], dict[str, list]]], schema: str) -> DataFrame:
    """Arrow batches through a Python function. make() runs once in each task and returns the function of columns to columns."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = fields
        do = make()
        for batch in batches:
            for part in pieces(batch):
                made = do({n: part.column(i).to_pylist() for i, n in enumerate(part.schema.names)})
                yield pa.RecordBatch.from_arrays([pa.array(made[f.name], f.type) for f in out], schema=out)

    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    fields = to_arrow_schema(StructType.fromDDL(schema))
    return df.mapInArrow(run, schema)


#: Rows and bytes of Arrow data that a Python stage turns into Python objects at a time.
PIECE_ROWS, PIECE_BYTES = 2000, 8 << 20


def pieces(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    rows = max(1, min(PIECE_ROWS, batch.num_rows * PIECE_BYTES // max(1, batch.nbytes)))
    for at in range(0, batch.num_rows, rows):
        yield batch.slice(at, rows)


def words_col(text) -> F.Column:
    """Array of the text's words; null: empty array."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), SPACE), lambda w: w != "")


def let(value, body) -> F.Column:
    """body(value) with value computed once a row: a higher-order function binds it, so no optimizer rule copies it into body."""
    return F.element_at(F.transform(F.array(value), body), 1)


def local_path(uri: str) -> str | None:
    return uri[7:] if uri.startswith("file://") else uri[5:] if uri.startswith("file:") else None if "://" in uri else uri


def file_system(uri: str):
    """(pyarrow file system, path) of a shared folder's URI."""
    import pyarrow.fs as fs

    if (path := local_path(uri)) is not None:
        return fs.LocalFileSystem(), os.path.abspath(path)
    return fs.FileSystem.from_uri(uri)


def ship(spark: SparkSession, value) -> Callable:
    """value on every executor, once a worker: a function that returns it. Classes go by value (broadcasts alone would pickle them by name)."""
    import pickle

    from pyspark import cloudpickle

    sent = spark.sparkContext.broadcast(cloudpickle.dumps(value))
    return lambda: pickle.loads(sent.value)


def once_a_process(slot: str, make: Callable, tag: str = ""):
    """make()'s value, kept as long as the Python worker lives, since workers run many tasks; a slot holds one value, that of the last tag.
    (Functions that go by value have new globals in every task.)"""
    import sys

    kept = sys.__dict__.setdefault("_parley_kept", {})
    if slot not in kept or kept[slot][0] != tag:
        kept.pop(slot, None)
        kept[slot] = tag, make()
    return kept[slot][1]
