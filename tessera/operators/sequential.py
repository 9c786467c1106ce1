"""Walks over sorted rows with a state, for what no window function can tell: each row's outcome depends on the state that earlier ones left."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

TYPES = {"string": pa.string(), "int": pa.int32(), "boolean": pa.bool_(), "double": pa.float64()}


def walk_sorted(df: DataFrame, by: tuple[str, ...], order: tuple[str, ...], needed: tuple[str, ...], start: Callable[[], object], step: Callable[[object, tuple], tuple], fields: dict[str, str]) -> DataFrame:
    """df with new fields: step(state, needed values) of each row, in order, with a fresh state for each group.

    One shuffle by group and a sort; rows stream through in Arrow batches, so neither many small groups nor a long one
    costs more than its rows.
    """
    names = df.columns
    columns = [names.index(c) for c in (*by, *needed)]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields) + "".join(f", {k} {v}" for k, v in fields.items())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group: tuple | None = None
        state: object = None
        for batch in batches:
            out = []
            for row in zip(*(batch.column(c).to_pylist() for c in columns)):
                if row[: len(by)] != group:
                    group, state = row[: len(by)], start()
                out.append(step(state, row[len(by) :]))
            told = list(zip(*out)) or [()] * len(fields)
            yield pa.RecordBatch.from_arrays([*batch.columns, *(pa.array(v, TYPES[t]) for v, t in zip(told, fields.values()))], names=[*names, *fields])

    return df.repartition(*by).sortWithinPartitions(*by, *order).mapInArrow(run, schema)
