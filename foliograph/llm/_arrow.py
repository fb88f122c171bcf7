"""Row-wise operators in Arrow batches, in small slices so that a worker's memory stays bounded."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.pandas.types import from_arrow_schema
from pyspark.sql.types import StructField, StructType

#: Bytes of the mapped column, about, that are worked on at a time; a longer single value is a slice of its own.
SLICE_BYTES = 1 << 20
#: Bytes, about, of an Arrow batch between a task and its Python worker; a longer single row is a batch of its own.
BATCH_BYTES = 2 << 20
BATCH_CONF, BATCH_DEFAULT = "spark.sql.execution.arrow.maxBytesPerBatch", 64 << 20


def small_batches(spark: SparkSession) -> None:
    """Sets the session's size of Arrow batches, which else is 64 MB in the task and again in the worker, unless the user has set it."""
    if spark.conf.get(BATCH_CONF, str(BATCH_DEFAULT)).rstrip("b") == str(BATCH_DEFAULT):
        spark.conf.set(BATCH_CONF, BATCH_BYTES)


def slices(column: pa.Array, most: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of rows with about `most` bytes each; of structs the first field counts."""
    column = column.field(0) if pa.types.is_struct(column.type) else column
    begin = held = 0
    for i, n in enumerate(pc.binary_length(column).fill_null(0).to_pylist()):
        if held and held + n > most:
            yield begin, i
            begin, held = i, 0
        held += n
    if begin < len(column):
        yield begin, len(column)


def with_struct(df: DataFrame, column: str, out_col: str, fields: pa.StructType, of: Callable[[pa.Array], Iterable[dict] | pa.Array], slice_bytes: int = SLICE_BYTES) -> DataFrame:
    """df with out_col, the structs that `of` makes of a slice of `column`, one for each row, in place of a column of that name."""
    small_batches(df.sparkSession)
    kept = [f for f in df.schema.fields if f.name != out_col]
    inner = from_arrow_schema(pa.schema(list(fields)))
    at = [f.name for f in df.schema.fields].index(column)
    keep = [i for i, f in enumerate(df.schema.fields) if f.name != out_col]
    schema = StructType([*kept, StructField(out_col, inner)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b in slices(batch.column(at), slice_bytes):
                part = batch.slice(a, b - a)
                made = of(part.column(at))
                made = made if isinstance(made, pa.Array) else pa.array(made, type=fields)
                yield pa.RecordBatch.from_arrays([*(part.column(i) for i in keep), made], names=[*(batch.schema.names[i] for i in keep), out_col])

    return df.mapInArrow(run, schema)
