"""Models over rows: a column goes through a model batch by batch, in tasks that load it once."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from formulary.functions.names import fresh

#: A loaded model: results of a list of inputs, as many and in their order.
Model = Callable[[list], list]

_LOADED: dict[str, Model] = {}


def _results(model: Model, items: list) -> list[tuple[Any, str | None]]:
    """Result and error of each item. A batch that fails is halved until the items that fail stand alone."""
    try:
        out = model(items)
        if len(out) != len(items):
            raise ValueError(f"{len(out)} results of {len(items)} inputs")
        return [(x, None) for x in out]
    except Exception as error:
        if len(items) == 1:
            return [(None, f"{type(error).__name__}: {error}")]
        half = len(items) // 2
        return _results(model, items[:half]) + _results(model, items[half:])


def predicted(rows: DataFrame, load: Callable[[], Model], column: str, kind: str = "string", into: str = "hyp", batch: int = 24, size: Callable[[Any], int] | None = None) -> DataFrame:
    """rows with a struct: value, what a model makes of a column, and error, why it made nothing. Null inputs aren't asked: both are null.

    load is run once a process and gives the model; a task asks it for batch inputs at a time. With size,
    inputs of about the same size share a batch, within some batches at a time. Ids and all other
    columns stay beside their row, in Arrow. Rows keep their order within a partition.
    """
    ask, rest = fresh(rows.drop(into), "_ask")[0], [c for c in rows.columns if c != into]
    read = rows.select(*rest, F.col(column).alias(ask))
    shape = StructType(read.drop(ask).schema.fields).add(into, StructType.fromDDL(f"value {kind}, error string"))
    kinds, name = to_arrow_schema(shape), uuid.uuid4().hex

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            items = b.column(len(rest)).to_pylist()
            asked = [k for k, x in enumerate(items) if x is not None]
            if size is not None:
                asked.sort(key=lambda k: size(items[k]))
            got: list = [None] * len(items)
            for at in range(0, len(asked), batch):
                if name not in _LOADED:
                    _LOADED[name] = load()
                some = asked[at : at + batch]
                for k, (value, error) in zip(some, _results(_LOADED[name], [items[k] for k in some]), strict=True):
                    got[k] = (value, error)
            made = pa.array([{"value": g[0], "error": g[1]} if g else {"value": None, "error": None} for g in got], kinds.field(into).type)
            yield pa.RecordBatch.from_arrays([*b.columns[: len(rest)], made], schema=kinds)

    return read.mapInArrow(run, shape)
