"""Helpers shared by the text operators."""

from __future__ import annotations

import os
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from tillrec.session import ensure_checkpoint_dir

#: ``bytes.split()`` cuts at exactly the six characters \x20 and \x09-\x0D, and ``bytes.lower()``
#: lowers exactly A-Z, so UTF-8 bytes give the words ``[^\x20\x09-\x0D]+`` at C speed.
SPACES = " \t\n\r\x0b\x0c"


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def byte_words(text: bytes | None, lower: bool = True) -> list[bytes]:
    """Words ``[^\\x20\\x09-\\x0D]+`` of a UTF-8 text, A-Z lowered if asked; none for null."""
    if not text:
        return []
    return (text.lower() if lower else text).split()


def slices(text: bytes, size: int) -> Iterator[bytes]:
    """A text in parts of about ``size`` bytes, cut before a space, so that no word is cut."""
    at = 0
    while len(text) - at > size:
        cut = text.find(b" ", at + size)
        if cut < 0:
            break
        yield text[at:cut]
        at = cut
    yield text[at:]


def utf8_column(batch: pa.RecordBatch, name: str) -> list[bytes | None]:
    """A string column of a batch as UTF-8 bytes, without decoding."""
    return batch.column(batch.schema.get_field_index(name)).cast(pa.binary()).to_pylist()


def column(batch: pa.RecordBatch, name: str) -> list:
    return batch.column(batch.schema.get_field_index(name)).to_pylist()


def arrow_schema(fields: dict[str, pa.DataType]) -> pa.Schema:
    return pa.schema(list(fields.items()))


def per_batch(fn: Callable[[pa.RecordBatch], pa.RecordBatch]
              ) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Lift a batch function to the iterator form of ``mapInArrow``."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield fn(batch)
    return run


def shared_path(spark: SparkSession, name: str) -> str:
    """A new folder name below the shared folder that spark.checkpoint.dir names."""
    return os.path.join(ensure_checkpoint_dir(spark), f"{name}-{uuid.uuid4().hex}")


def stored(df: DataFrame, name: str, **options: str) -> DataFrame:
    """Write a frame to the shared folder and read it back: cuts the lineage, so neither a lost
    executor nor a second consumer recomputes what lies before it. ``options`` are the writer's."""
    spark = df.sparkSession
    path = shared_path(spark, name)
    df.write.options(**options).parquet(path)
    return spark.read.schema(df.schema).parquet(path)
