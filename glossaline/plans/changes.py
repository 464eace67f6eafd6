"""Applying a change table (insert / update / delete rows) to a keyed table."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from .ordered import number_rows


def apply_changes(
    table: DataFrame,
    changes: DataFrame,
    key: str = "id",
    required: tuple[str, ...] = (),
    insert_order: str = "change_no",
) -> DataFrame:
    """New state of ``table``.

    ``changes`` holds ``op`` (insert / update / delete), the key, ``insert_order`` and nullable
    columns: a null in an update keeps the old value.  Later updates of the same row win column
    by column.  Inserts missing a required value are refused; the others get the next free keys.
    """
    columns = [c for c in table.columns if c != key]
    deletes = changes.filter(F.col("op") == "delete").select(key).distinct()
    # Pre-aggregated per key: the newest non-null value of each column.
    updates = (
        changes.filter(F.col("op") == "update")
        .groupBy(key)
        .agg(*[F.max_by(F.col(c), F.when(F.col(c).isNotNull(), F.col(insert_order))).alias(f"_new_{c}") for c in columns])
    )
    kept = (
        table.join(deletes, key, "left_anti")
        .join(updates, key, "left")
        .select(key, *[F.coalesce(F.col(f"_new_{c}"), F.col(c)).alias(c) for c in columns])
    )
    inserts = changes.filter(F.col("op") == "insert")
    for column in required:
        inserts = inserts.filter(F.trim(F.coalesce(F.col(column), F.lit(""))) != "")
    numbered = number_rows(inserts.select(insert_order, *columns), [], [insert_order], "_nth")
    top = table.agg(F.coalesce(F.max(key), F.lit(0)).alias("_top"))
    added = numbered.select(
        (top.scalar() + F.col("_nth")).cast(dict(table.dtypes)[key]).alias(key), *columns
    )
    return kept.select(key, *columns).unionByName(added)
