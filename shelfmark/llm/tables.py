"""Reading the tables and shaping operator inputs."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from .words import SLICE_BYTES, slices


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def per_slice(
    df: DataFrame, work: Callable[[], Callable[[pa.RecordBatch], dict]], schema: str | T.StructType, text: str = "text",
    limit: int = SLICE_BYTES,
) -> DataFrame:
    """Maps bounded slices of ``df`` to rows of ``schema``.

    ``work`` is called once per task and returns the function of one slice; that function returns columns by
    name. Tasks keep no state between slices, so a lost executor only repeats its tasks.
    """
    types = T.StructType.fromDDL(schema) if isinstance(schema, str) else schema
    arrow = to_arrow_schema(types)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        one = work()
        for batch in batches:
            for part in slices(batch, text, limit):
                columns = one(part)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(columns[f.name], type=f.type, from_pandas=False) for f in arrow], schema=arrow
                )

    return df.mapInArrow(run, types)
