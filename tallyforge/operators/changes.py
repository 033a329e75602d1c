"""Changes to stored tables as keyed joins: a batch of inserts, updates or deletes with the table gives the next table.

Each function takes and gives frames, so any number of rows is changed by one job and the results are written by
Spark's own table writers. :func:`violations` says which keys the next tables would break; write them if there are
none. Null keys name nothing: rows with one are never changed or deleted.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, functions as F

from ..sources import schemas
from .proposals import orphans, repeated_keys


def _now() -> Column:
    return F.current_timestamp().cast("timestamp_ntz")


def with_defaults(name: str, rows: DataFrame) -> DataFrame:
    """``rows`` in the columns of the table ``name``: generated ids, times and the declared defaults where values are missing."""
    defaults = {
        "id": F.uuid(), "created_at": _now(), "updated_at": _now(), "active": F.lit(True), "status": F.lit("draft"), "needs_new_authority": F.lit(False), "is_primary": F.lit(False),
        "budget_one_time_usd": F.lit(0), "budget_annual_usd": F.lit(0), "one_time_usd": F.lit(0), "annual_usd": F.lit(0), "confidence": F.lit(0.5),
    }
    out = []
    for field in schemas.fields(name):
        value = F.col(field.name) if field.name in rows.columns else F.lit(None)
        value = value.cast(field.dataType)
        out.append((F.coalesce(value, defaults[field.name].cast(field.dataType)) if field.name in defaults else value).alias(field.name))
    return rows.select(*out)


def updated(table: DataFrame, changes: DataFrame, key: str = "id", touch: str | None = None) -> DataFrame:
    """``table`` with the columns that ``changes`` has beside ``key`` set, nulls too, in the rows it names.

    Keys of ``changes`` are distinct; one that the table has not changes nothing. ``touch`` names a timestamp column
    that is set to now in changed rows, unless ``changes`` sets it.
    """
    own = [c for c in changes.columns if c != key]
    new = changes.select(F.col(key).alias("_key"), F.struct(*own).alias("_new"))
    joined = table.join(new, F.col(key) == F.col("_key"), "left")
    hit = F.col("_key").isNotNull()
    values = {c: F.when(hit, F.col("_new")[c]).otherwise(F.col(c)) for c in own}
    if touch and touch not in own:
        values[touch] = F.when(hit, _now()).otherwise(F.col(touch))
    return joined.select(*[values[c].cast(kind).alias(c) if c in values else F.col(c) for c, kind in table.dtypes])


def returning(table: DataFrame, keys: DataFrame, key: str = "id") -> DataFrame:
    """The rows of ``table`` that a change of ``keys`` gives back."""
    return table.join(keys.select(F.col(key).alias("_key")).distinct(), F.col(key) == F.col("_key"), "left_semi")


def deleted(tables: Mapping[str, DataFrame], name: str, keys: DataFrame, foreign_keys=schemas.FOREIGN_KEYS) -> dict[str, DataFrame]:
    """The tables without the rows of ``name`` whose ids are in ``keys`` (id), and without what cascades from them."""
    out = dict(tables)
    gone = keys.select(F.col("id").alias("_key")).distinct()
    out[name] = tables[name].join(gone, F.col("id") == F.col("_key"), "left_anti")
    for child, column, parent, rule in foreign_keys:
        if parent == name and rule == "cascade" and child in out:
            out[child] = out[child].join(gone, F.col(column) == F.col("_key"), "left_anti")
    return out


def restricted(tables: Mapping[str, DataFrame], name: str, keys: DataFrame, foreign_keys=schemas.FOREIGN_KEYS) -> DataFrame:
    """(id, child, n): the ids of ``keys`` that may not be deleted from ``name``, as n rows of ``child`` name them."""
    found = keys.select("id").distinct().withColumn("child", F.lit(None).cast("string")).withColumn("n", F.lit(0).cast("long")).limit(0)
    for child, column, parent, rule in foreign_keys:
        if parent == name and rule == "restrict" and child in tables:
            named = tables[child].join(keys.select("id").distinct(), F.col(column) == keys["id"], "left_semi")
            found = found.unionByName(named.groupBy(F.col(column).alias("id")).agg(F.lit(child).alias("child"), F.count("*").alias("n")))
    return found


def violations(tables: Mapping[str, DataFrame], foreign_keys=schemas.FOREIGN_KEYS, unique_keys=schemas.UNIQUE_KEYS) -> DataFrame:
    """(table, rule, key): every key that names a missing row or is there more than once."""
    found = []
    for child, column, parent, _ in foreign_keys:
        if child in tables and parent in tables:
            rows = orphans(tables[child], column, tables[parent])
            found.append(rows.select(F.lit(child).alias("table"), F.lit(f"{column} names a missing {parent}").alias("rule"), F.col(column).cast("string").alias("key")).distinct())
    for name, rows in tables.items():
        for keys in [k for t, k in unique_keys if t == name] + ([("id",)] if "id" in rows.columns else []):
            repeated = repeated_keys(rows, *keys)
            found.append(repeated.select(F.lit(name).alias("table"), F.lit(f"{', '.join(keys)} is repeated").alias("rule"), F.concat_ws(", ", *[F.col(k).cast("string") for k in keys]).alias("key")))
    out = found[0]
    for part in found[1:]:
        out = out.unionByName(part)
    return out
