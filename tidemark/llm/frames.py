"""Column plumbing shared by the operators: added columns replace input columns of the same name."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

LAST_ID = (1 << 63) - 1  # where a null doc_id sorts


def field(name: str, kind: str) -> T.StructField:
    return T.StructField(name, T._parse_datatype_string(kind))


def kept_columns(df: DataFrame, added: list[str]) -> list[str]:
    taken = {a.lower() for a in added}
    return [c for c in df.columns if c.lower() not in taken]


def order_id() -> F.Column:
    """The doc_id by which documents are ordered: null comes after all others."""
    return F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST_ID))


def slices(batch: pa.RecordBatch, column: str, limit: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """The batch in runs of rows of about so many bytes of text, so that a task's memory doesn't follow Spark's batch size."""
    size = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    lo = 0
    while lo < batch.num_rows:
        hi = max(lo + 1, int(np.searchsorted(size, (size[lo - 1] if lo else 0) + limit, side="right")))
        yield batch.slice(lo, hi - lo)
        lo = hi


def map_columns(df: DataFrame, added: dict[str, str], fn: Callable[[pa.RecordBatch], dict[str, pa.Array]], drop: tuple[str, ...] = (), text: str = "text") -> DataFrame:
    """Adds the columns that fn computes, row for row, from Arrow batches of a bounded amount of text."""
    keep = [c for c in kept_columns(df, list(added)) if c not in drop]
    schema = T.StructType([df.schema[c] for c in keep] + [field(n, k) for n, k in added.items()])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, text):
                new = fn(batch)
                yield pa.RecordBatch.from_arrays([batch.column(c) for c in keep] + [new[n] for n in added], names=keep + list(added))

    return df.mapInArrow(run, schema)
