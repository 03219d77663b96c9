"""Groups of keys, and their rows and states as Arrow blobs: what the stateful streams keep instead of a state for each key."""

from __future__ import annotations

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Groups that keys are dealt into. A stream keeps this number as long as its checkpoint lives.
BUCKETS = 1024
_TYPES = {"long": pa.int64(), "string": pa.string(), "boolean": pa.bool_()}


def bucket(*key: Column) -> Column:
    return F.pmod(F.xxhash64(*key), F.lit(BUCKETS))


def pack_columns(columns: dict, types: dict[str, str]) -> bytes:
    """Columns (name: values, null or NaN being none) as an Arrow stream."""
    made = pa.record_batch([pa.Array.from_pandas(columns[c], type=_TYPES[t]) for c, t in types.items()], names=list(types))
    out = pa.BufferOutputStream()
    with pa.ipc.new_stream(out, made.schema) as writer:
        writer.write_batch(made)
    return out.getvalue().to_pybytes()


def pack(rows: list[tuple], types: dict[str, str]) -> bytes:
    return pack_columns(dict(zip(types, zip(*rows, strict=True), strict=True)), types)


def unpack(blob: bytes) -> list[tuple]:
    table = pa.ipc.open_stream(blob).read_all()
    return list(zip(*(c.to_pylist() for c in table.columns), strict=True))


def frame(rows: list[tuple], names: list[str], whole: set[str]) -> pd.DataFrame:
    """Rows as a table for Spark; whole numbers stay whole beside nulls."""
    return pd.DataFrame({c: pd.array(list(v), "Int64") if c in whole else list(v) for c, v in zip(names, zip(*rows, strict=True), strict=True)})
