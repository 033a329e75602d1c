"""How many tasks rows are dealt out to, so that a task's memory does not grow with a table."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame

#: Rows that a task sorts or tells apart at once.
ROWS_AT_ONCE = 400_000


def spread(rows: DataFrame, number: int, *keys: str) -> DataFrame:
    """``rows`` by ``keys`` over as many tasks as ``number`` rows ask for, and more than Spark's own number of shuffle partitions.

    Spark would leave out a shuffle into as many partitions as the one before, and then put partitions together by their bytes.
    """
    return rows.repartition(max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")) + 1, math.ceil(number / ROWS_AT_ONCE)), *keys)
