"""The registry of cities: which are valid, and how that changes.

Names are unique in a registry, so its own joins have no hot key.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..schemas import REGISTRY
from .skew import BROADCAST_BYTES, SPLIT_ROWS, semi_join

REGISTRY_COLUMNS = [f.name for f in REGISTRY.fields]
NAME_NOT_FOUND = "city not found in database"


def valid_cities(registry: DataFrame) -> DataFrame:
    """Valid entries only; an entry whose flag is NULL is not valid."""
    return registry.where(F.col("valid_entry")).select(*REGISTRY_COLUMNS)


def valid_cities_by_name(registry: DataFrame) -> DataFrame:
    return valid_cities(registry).orderBy("name")


def of_valid_cities(
    rows: DataFrame,
    registry: DataFrame,
    split_rows: int = SPLIT_ROWS,
    broadcast_bytes: int = BROADCAST_BYTES,
) -> DataFrame:
    """Rows whose city is a valid registry entry."""
    names = registry.where(F.col("valid_entry")).select(F.col("name").alias("city"))
    return semi_join(rows, names, "city", "seq", split_rows, broadcast_bytes)


def mark_invalid(registry: DataFrame, names: DataFrame) -> DataFrame:
    """The registry with the named cities no longer valid.

    Other entries keep their flag, a NULL flag included.
    """
    named = names.select("name").distinct().withColumn("_named", F.lit(True))
    return registry.join(named, "name", "left").select(
        *[
            F.when(F.col("_named"), F.lit(False)).otherwise(F.col(c)).alias(c)
            if c == "valid_entry"
            else F.col(c)
            for c in registry.columns
        ]
    )


def invalidation_report(registry: DataFrame, names: DataFrame) -> DataFrame:
    """``(name, rows_affected, error)`` per named city.

    An entry that was invalid already counts as affected; a name without an
    entry affects 0 rows and is an error.
    """
    known = registry.select("name").withColumn("_known", F.lit(True))
    found = F.col("_known").isNotNull()
    return (
        names.select("name")
        .distinct()
        .join(known, "name", "left")
        .select(
            "name",
            F.when(found, 1).otherwise(0).alias("rows_affected"),
            F.when(~found, F.lit(NAME_NOT_FOUND)).alias("error"),
        )
    )


def seed_rows_to_add(registry: DataFrame, seed: DataFrame) -> DataFrame:
    """Seed rows whose name is new, the first of each repeated name.

    ``seed`` may carry ``position``, the order of its rows; without it any one
    row of a repeated name is taken.
    """
    order = "position" if "position" in seed.columns else "name"
    first = W.partitionBy("name").orderBy(order)
    return (
        seed.withColumn("_rank", F.row_number().over(first))
        .where(F.col("_rank") == 1)
        .drop("_rank")
        .join(registry.select("name"), "name", "left_anti")
    )


def insert_seed(registry: DataFrame, seed: DataFrame) -> DataFrame:
    """The registry with the new seed rows, valid and created now.

    The natural key is the name; new rows carry no surrogate id.
    """
    added = seed_rows_to_add(registry, seed).select(
        F.lit(None).cast(registry.schema["id"].dataType).alias("id"),
        "name",
        "country",
        "continent",
        F.lit(True).alias("valid_entry"),
        F.current_timestamp().cast(registry.schema["created_at"].dataType).alias("created_at"),
    )
    return registry.select(*REGISTRY_COLUMNS).unionByName(added)


def newest_flags(changes: DataFrame) -> DataFrame:
    """``(name, valid_entry, flag_at)``: the newest of each name's changes.

    Of two changes at one time, the one that makes the entry invalid wins; a
    change without a time is older than any other.
    """
    invalid = ~F.coalesce("valid_entry", F.lit(False))
    newest = F.max(F.struct("flag_at", invalid.alias("invalid"), "valid_entry")).alias("_newest")
    return changes.groupBy("name").agg(newest).select("name", "_newest.valid_entry", "_newest.flag_at")


def apply_flags(registry: DataFrame, newest: DataFrame) -> DataFrame:
    """The registry with every flag that has changed since its own ``flag_at``.

    ``newest`` has each name once (``newest_flags``); names without an entry are
    left out. At equal times an invalid flag wins.
    """
    c = F.col
    at, flag = c("_change.flag_at"), c("_change.valid_entry")
    older = c("flag_at").isNull() | (c("flag_at") < at)
    tie = (c("flag_at") == at) & ~F.coalesce(flag, F.lit(False))
    taken = F.coalesce(at.isNotNull() & (older | tie), F.lit(False))
    change = newest.select("name", F.struct("valid_entry", "flag_at").alias("_change"))
    new = {"valid_entry": flag, "flag_at": at}
    return registry.join(change, "name", "left").select(
        *[F.when(taken, new[n]).otherwise(c(n)).alias(n) if n in new else c(n) for n in registry.columns]
    )


def merge_registry(stored: DataFrame, incoming: DataFrame) -> DataFrame:
    """The rows of ``incoming``, each with the newer of its own and its stored flag."""
    return apply_flags(incoming, stored.select("name", "valid_entry", "flag_at"))


def reload_summary(old: DataFrame, new: DataFrame) -> DataFrame:
    """One row ``(old_count, new_count, change, label)`` for a registry reload.

    Counts are of valid entries. One scan of each side, one tiny aggregate.
    """
    sides = old.where("valid_entry").select(F.lit(1).alias("o"), F.lit(0).alias("n")).unionAll(
        new.where("valid_entry").select(F.lit(0).alias("o"), F.lit(1).alias("n"))
    )
    return summarized(
        sides.agg(
            F.coalesce(F.sum("o"), F.lit(0)).alias("old_count"),
            F.coalesce(F.sum("n"), F.lit(0)).alias("new_count"),
        )
    )


def summarized(counts: DataFrame) -> DataFrame:
    """Adds ``change`` and ``label`` to rows with ``old_count`` and ``new_count``."""
    c = F.col
    counts = counts.withColumn("change", c("new_count") - c("old_count"))
    old_text, new_text = c("old_count").cast("string"), c("new_count").cast("string")
    label = (
        F.when(
            (c("old_count") == 0) & (c("new_count") > 0),
            F.concat(F.lit("Cities loaded: 0 → "), new_text, F.lit(" (scheduler now active!)")),
        )
        .when(
            c("change") != 0,
            F.concat(
                F.lit("Cities reloaded: "), old_text, F.lit(" → "), new_text,
                F.lit(" (change: "), F.when(c("change") > 0, "+").otherwise(""),
                c("change").cast("string"), F.lit(")"),
            ),
        )
        .otherwise(F.concat(F.lit("Cities reloaded: "), new_text, F.lit(" (no changes)")))
    )
    return counts.withColumn("label", label)
