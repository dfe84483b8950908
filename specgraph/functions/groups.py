"""Small groups of rows in Python: many to a task, without a data frame for each."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from itertools import groupby
from operator import itemgetter

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

#: Rows that leave a task at a time.
ROWS = 5000


def per_group(rows: DataFrame, key: str, each: Callable[[object, list[tuple]], Iterable[tuple]], schema: str) -> DataFrame:
    """What ``each(key, rows)`` gives of every group, as tuples of ``schema``; a row is a tuple in the order of the columns.

    Groups come one after the other out of sorted partitions, so that a task holds one group and a batch; the order of a group's rows is not fixed.
    """
    made = to_arrow_schema(StructType.fromDDL(schema), prefers_large_types=False)
    at = rows.columns.index(key)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lines = (r for b in batches for r in zip(*(c.to_pylist() for c in b.columns)))
        out: list[tuple] = []

        def batch() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), made)], schema=made)

        for k, group in groupby(lines, key=itemgetter(at)):
            out.extend(each(k, list(group)))
            if len(out) >= ROWS:
                yield batch()
                out.clear()
        if out:
            yield batch()

    return rows.repartition(key).sortWithinPartitions(key).mapInArrow(run, schema)
