"""Validated exports stored for several consumers: only what they read, all exports at once."""

from __future__ import annotations

import uuid

from pyspark import InheritableThread
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tillrec.operators import validate as V
from tillrec.session import ensure_checkpoint_dir
from tillrec.sources.spec import SourceSpec


def needed(validated: DataFrame, spec: SourceSpec, originals: bool) -> DataFrame:
    """Typed fields, error and order keys; the original texts only of rejected rows, and only if asked for
    (valid rows are fully described by their fields)."""
    carried = [c for c in (V.ERROR_COL, V.ROW_COL, "_file", "_block", V.BLANK_COL) if c in validated.columns]
    raw = [c for c in validated.columns if c.startswith("raw_")] if originals else []
    rejected = F.col(V.ERROR_COL).isNotNull()
    return validated.select(*spec.field_names, *carried, *[F.when(rejected, F.col(c)).alias(c) for c in raw])


def stored(validated: dict[str, tuple[DataFrame, SourceSpec]], originals: bool = True) -> dict[str, DataFrame]:
    """Write the exports to the shared folder side by side, so a small one doesn't wait for a large one; consumers
    then read just their columns, and a lost executor never forces a re-parse."""
    spark = next(iter(validated.values()))[0].sparkSession
    root = f"{ensure_checkpoint_dir(spark)}/exports-{uuid.uuid4().hex}"
    out: dict[str, DataFrame] = {}
    failed: list[BaseException] = []

    def write(name: str, rows: DataFrame) -> None:
        try:
            rows.write.parquet(f"{root}/{name}")
        except BaseException as e:  # noqa: BLE001 - raised below, in the caller's thread
            failed.append(e)

    threads = []
    for name, (frame, spec) in validated.items():
        rows = needed(frame, spec, originals)
        threads.append(InheritableThread(target=write, args=(name, rows)))
        out[name] = rows
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    if failed:
        raise failed[0]
    return {name: spark.read.schema(rows.schema).parquet(f"{root}/{name}") for name, rows in out.items()}
