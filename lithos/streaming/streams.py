"""Structured Streaming: tailing a log folder, archetype-granular changes in a
micro-batch, subscriptions, and stateful debouncing."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from lithos.operators.changes import changed_archetypes


def tail(spark: SparkSession, path: str, schema: str | T.StructType, files_per_trigger: int = 1) -> DataFrame:
    """A folder of Parquet records as a stream, a few files at a time."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def subscribe(stream: DataFrame, condition, deliver: Callable[[DataFrame, int], Any], checkpoint: str, available_now: bool = True) -> StreamingQuery:
    """Deliver the rows of each micro-batch that meet the condition."""
    writer = stream.where(condition).writeStream.foreachBatch(deliver).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def changed_state(state: Callable[[], DataFrame], archetype: str, deliver: Callable[[DataFrame, int], Any]) -> Callable[[DataFrame, int], None]:
    """For ``foreachBatch``: all current rows of the archetypes that the batch
    touched, by a semi join."""

    def run(batch: DataFrame, number: int) -> None:
        touched = batch.select(archetype).distinct()
        deliver(state().join(touched, archetype, "left_semi"), number)

    return run


def debounced(stream: DataFrame, entity: str, value: str, order: list[str]) -> DataFrame:
    """Rows that are the first of their entity or differ from the last one seen,
    across micro-batches; each batch is taken in the given order."""
    schema = stream.schema
    kind = schema[value].dataType
    names = schema.names

    def run(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        rows = pd.concat(list(frames)).sort_values(order, kind="stable")
        seen, last = (True, state.get[0]) if state.exists else (False, None)
        keep = []
        for v in rows[value].tolist():
            keep.append(not seen or v != last)
            seen, last = True, v
        state.update((last,))
        yield rows.loc[keep, names]

    return stream.groupBy(entity).applyInPandasWithState(run, schema, T.StructType([T.StructField("last", kind)]), "append", GroupStateTimeout.NoTimeout)


__all__ = ["changed_archetypes", "changed_state", "debounced", "subscribe", "tail"]
