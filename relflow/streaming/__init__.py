"""Streams: the stateless operators of a relation work on streaming frames as they are.

The followed model has no windows, watermarks or state, and none are added.
"""

from __future__ import annotations

from collections.abc import Callable
from typing import Any

from pyspark.sql import SparkSession
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from relflow.relation import Relation


def read_stream(spark: SparkSession, format: str, schema: str | T.StructType, location: str, **options: Any) -> Relation:
    return Relation(spark.readStream.format(format).schema(schema).options(**options).load(location))


def write_stream(rel: Relation, format: str, location: str, checkpoint: str, available_now: bool = True) -> StreamingQuery:
    """Appends to files exactly once; ``available_now`` stops when all input is read."""
    writer = rel.df.writeStream.format(format).option("path", location).option("checkpointLocation", checkpoint).outputMode("append")
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def for_each_batch(rel: Relation, f: Callable[[Relation], Any], checkpoint: str) -> StreamingQuery:
    """``f`` on each micro-batch as a bounded relation, where every operator works."""
    return rel.df.writeStream.foreachBatch(lambda df, _: f(Relation(df)) and None).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
