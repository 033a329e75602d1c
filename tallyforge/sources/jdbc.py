"""Tables of a relational database, read and written by Spark's JDBC source."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from . import schemas


def read(spark: SparkSession, url: str, name: str, column: str | None = None, partitions: int = 1, **options: str) -> DataFrame:
    """The table ``name`` in the types of its schema, filters and columns pushed to the database.

    With a numeric, date or timestamp ``column`` the rows are read in ``partitions`` ranges of it, from its least to its
    greatest value; without one by a single task.
    """
    reader = spark.read.format("jdbc").option("url", url).option("dbtable", name).options(**options)
    if column is not None and partitions > 1:
        low, high = reader.load().agg(F.min(column), F.max(column)).first()
        if low is not None:
            reader = reader.option("partitionColumn", column).option("lowerBound", str(low)).option("upperBound", str(high)).option("numPartitions", str(partitions))
    rows = reader.load()
    if name not in schemas.TABLES:
        return rows
    columns = {c.lower(): c for c in rows.columns}
    return rows.select(*[F.col(columns[f.name]).cast(f.dataType).alias(f.name) for f in schemas.fields(name)])


def write(rows: DataFrame, url: str, name: str, mode: str = "append", **options: str) -> None:
    """Appends ``rows`` to the table ``name``, or with mode 'overwrite' replaces it, a batch for each partition."""
    rows.write.format("jdbc").option("url", url).option("dbtable", name).options(**options).mode(mode).save()
