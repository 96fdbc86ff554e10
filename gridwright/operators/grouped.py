"""Running a kernel on each image: columns of one image in, columns out, over Arrow."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame

ARROW = {"int": pa.int32(), "long": pa.int64(), "double": pa.float64(), "boolean": pa.bool_(), "string": pa.string(), "array<int>": pa.list_(pa.int32())}


def _table(schema: str, columns: dict) -> pa.Table:
    fields = [f.strip().split(" ") for f in schema.split(",")]
    return pa.table([pa.array(columns[n], ARROW[t]) for n, t in fields], names=[n for n, _ in fields])


def per_group(df: DataFrame, key: str, kernel: Callable[[dict[str, np.ndarray]], dict], schema: str) -> DataFrame:
    """kernel gets the columns of one group as arrays, and returns those of schema without the key."""

    def run(group: pa.Table) -> pa.Table:
        cols = {n: group[n].to_numpy(zero_copy_only=False) for n in group.column_names}
        out = kernel(cols)
        n = len(next(iter(out.values())))
        return _table(f"{key} long, {schema}", {key: [group[key][0].as_py()] * n, **out})

    return df.groupBy(key).applyInArrow(run, f"{key} long, {schema}")


def per_sorted(df: DataFrame, key: str, order: list[str | Column], kernel: Callable[[Iterator[dict[str, np.ndarray]]], Iterator[dict]], schema: str) -> DataFrame:
    """The same on groups that need not fit a worker: the kernel gets a group's columns in pieces, its rows in the given order, which
    Spark sorts on disk, and yields its result in pieces."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name = None

        def pieces() -> Iterator[dict[str, np.ndarray]]:
            nonlocal name
            for b in batches:
                if b.num_rows:
                    name = b[key][0].as_py()
                    yield {n: b[n].to_numpy(zero_copy_only=False) for n in b.schema.names}

        for out in kernel(pieces()):
            n = len(next(iter(out.values())))
            yield from _table(f"{key} long, {schema}", {key: np.full(n, name), **out}).to_batches()

    return df.repartition(key).sortWithinPartitions(key, *order).groupBy(key).applyInArrow(run, f"{key} long, {schema}")


def per_pair(left: DataFrame, right: DataFrame, key: str, kernel: Callable[[dict, dict], dict], schema: str) -> DataFrame:
    """The same on two tables with a common key; either may lack a group and then has empty columns."""

    def run(a: pa.Table, b: pa.Table) -> pa.Table:
        cols = [{n: t[n].to_numpy(zero_copy_only=False) for n in t.column_names} for t in (a, b)]
        out = kernel(*cols)
        n = len(next(iter(out.values())))
        name = (a if a.num_rows else b)[key][0].as_py()
        return _table(f"{key} long, {schema}", {key: [name] * n, **out})

    return left.groupBy(key).cogroup(right.groupBy(key)).applyInArrow(run, f"{key} long, {schema}")
