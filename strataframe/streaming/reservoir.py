"""A bounded hash sample kept up to date over micro-batches: the one operator of the set with natural incremental state."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame

from ..operators.select import top_k


def merge(state: DataFrame | None, batch: DataFrame, by: list[str], k: int, priority: Column, key: str) -> DataFrame:
    """The k first rows per stratum of what was kept and what is new. Equal to one pass over all rows, in any order of batches."""
    both = batch if state is None else state.unionByName(batch)
    return top_k(both.dropDuplicates([*by, key]), by, k, priority, key)


def sink(path: Callable[[int], str], by: list[str], k: int, priority: Column, key: str) -> Callable[[DataFrame, int], None]:
    """For writeStream.foreachBatch: path(i) is the state after batch i; a batch that is run again writes the same rows."""

    def run(batch: DataFrame, i: int) -> None:
        state = batch.sparkSession.read.schema(batch.schema).parquet(path(i - 1)) if i else None
        merge(state, batch, by, k, priority, key).write.mode("overwrite").parquet(path(i))

    return run
