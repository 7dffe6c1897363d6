"""Caps on streams: of each key only so many rows, in the order they come, over all batches and restarts."""

from __future__ import annotations

from collections.abc import Iterator
from heapq import nsmallest

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import LongType, StructField, StructType

from formulary.functions.names import fresh


class _Capped(StatefulProcessor):
    """Rows of a key that were let through; forgotten after a time without any if one is set."""

    def __init__(self, columns: list[str], order: list[str], most: int, forget_ms: int | None) -> None:
        self.columns, self.order, self.most, self.forget_ms = columns, order, most, forget_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        state = StructType([StructField("n", LongType())])
        self.passed = handle.getValueState("passed", state, self.forget_ms) if self.forget_ms else handle.getValueState("passed", state)

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        passed = self.passed.get()[0] if self.passed.exists() else 0
        if passed >= self.most:
            return
        place = lambda r: [(r[c] is not None, r[c]) for c in self.order]
        first = nsmallest(self.most - passed, rows, place)  # only these of a hot key are held
        if first:
            self.passed.update((passed + len(first),))
            yield from (Row(**{c: r[c] for c in self.columns}) for r in first)

    def close(self) -> None:
        pass


def capped_stream(stream: DataFrame, by: list, order: list[str], most: int, exempt: Column | None = None, forget_ms: int | None = None) -> DataFrame:
    """The first so many rows of each key, over all batches; within a batch by order, nulls first. Exempt rows always stay and don't count; a null key is a key.

    Where batches cut the order, the rows are those of capped() on all of them. The state of a key is
    one number; with forget_ms it goes that long after the key's last row, and its count starts anew.
    Stores its state in RocksDB, which the session must name as its provider.
    """
    if exempt is not None:
        free = F.coalesce(exempt, F.lit(False))
        return stream.where(free).unionByName(capped_stream(stream.where(~free), by, order, most, None, forget_ms))
    (key,) = fresh(stream, "_key")
    keyed = stream.withColumn(key, F.to_json(F.struct(*(c if isinstance(c, Column) else F.col(c) for c in by))))
    processor = _Capped(stream.columns, order, most, forget_ms)
    return keyed.groupBy(key).transformWithState(processor, stream.schema, "Append", "ProcessingTime" if forget_ms else "None")


#: What a session needs for capped_stream().
PROVIDER = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
