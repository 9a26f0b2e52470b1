"""Joins and numbering that stay even when one key owns a third of the rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

#: A key is spread out once it has this many rows; at most HOT_KEYS keys are.
HOT_ROWS = 100_000
HOT_KEYS = 1_000


def hot_keys(df: DataFrame, on: Sequence[str], rows: int = HOT_ROWS) -> DataFrame:
    """The keys with the most rows, never more than ``HOT_KEYS`` of them.

    Counting combines map-side and the top list is bounded by construction, so the
    result may be broadcast. A key that misses the list holds under 1/HOT_KEYS of
    the rows and needs no treatment.
    """
    counts = df.groupBy(*on).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") >= rows)
    for key in on:
        counts = counts.where(F.col(key).isNotNull())
    return counts.orderBy(F.desc("_n"), *on).limit(HOT_KEYS).select(*on, F.lit(True).alias("_hot"))


def spread_join(
    left: DataFrame,
    right: DataFrame,
    on: Sequence[str],
    by: Sequence[str],
    how: str = "left",
    salts: int = 32,
    rows: int = HOT_ROWS,
    counted: DataFrame | None = None,
) -> DataFrame:
    """Join ``left`` to ``right`` (few rows per key) with the hot keys of ``left`` salted.

    ``by`` names columns of ``left`` that tell its rows apart; their hash picks the
    salt, so a lost task recomputes the same placement. ``counted`` may be a cheaper
    frame with the same key frequencies, to keep the counting pass off heavy plans.
    """
    if how not in ("left", "inner"):
        raise ValueError(f"spread_join supports left and inner joins, not {how!r}")
    on = list(on)
    hot = F.broadcast(hot_keys(counted if counted is not None else left, on, rows))
    salt = F.pmod(F.xxhash64(*by), F.lit(salts)).cast("int")
    missing = F.lit(False)
    for key in on:
        missing = missing | F.col(key).isNull()
    salted = left.join(hot, on, "left").withColumn(
        "_salt", F.when(F.col("_hot") | missing, salt).otherwise(F.lit(0))
    ).drop("_hot")
    every = F.sequence(F.lit(0), F.lit(salts - 1))
    copies = right.join(hot, on, "left").withColumn(
        "_salt", F.explode(F.when(F.col("_hot"), every).otherwise(F.array(F.lit(0))))
    ).drop("_hot")
    return salted.join(copies, [*on, "_salt"], how).drop("_salt")


def latest(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """The row with the greatest ``order`` per key, by an aggregate that combines map-side."""
    rest = [c for c in df.columns if c not in keys]
    best = F.max_by(F.struct(*rest), F.struct(*[o.alias(f"o{i}") for i, o in enumerate(order)]))
    return df.groupBy(*keys).agg(best.alias("_row")).select(*keys, "_row.*").select(*df.columns)


def as_of_join(
    left: DataFrame, right: DataFrame, on: Sequence[str], time: str, by: Sequence[str], into: str, salts: int = 32, rows: int = HOT_ROWS
) -> DataFrame:
    """``left`` with ``into``: the newest row of ``right`` that has the same key and is not younger than the left row.

    Both sides are sorted once by key and time and swept in one pass, so versions are never paired with rows. Hot keys of
    ``left`` are swept in salted parts, each of which sees all versions. Versions of one time: the greatest row decides.
    A left row without time or version gets NULL.
    """
    on = list(on)
    rest = [c for c in right.columns if c not in (*on, time)]
    hot = F.broadcast(hot_keys(left, on, rows))
    missing = F.lit(False)
    for key in on:
        missing = missing | F.col(key).isNull()
    salt = F.when(F.col("_hot") | missing, F.pmod(F.xxhash64(*by), F.lit(salts)).cast("int")).otherwise(F.lit(0))
    every = F.when(F.col("_hot"), F.sequence(F.lit(0), F.lit(salts - 1))).otherwise(F.array(F.lit(0)))
    rows_ = left.join(hot, on, "left").select(*on, salt.alias("_salt"), F.col(time).alias("_at"), F.lit(1).alias("_side"), F.struct(*left.columns).alias("_row"))
    versions = right.where(F.col(time).isNotNull()).join(hot, on, "left").select(
        *on, F.explode(every).alias("_salt"), F.col(time).alias("_at"), F.lit(0).alias("_side"), F.struct(*rest).alias("_version"))
    sweep = Window.partitionBy(*on, "_salt").orderBy("_at", "_side", "_version").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    swept = rows_.unionByName(versions, allowMissingColumns=True).withColumn("_seen", F.last("_version", ignorenulls=True).over(sweep))
    return swept.where("_side = 1").select("_row.*", F.col("_seen").alias(into))


def running_offsets(
    counts: DataFrame, group: str, seq: str, n: str, chunk: int = 4096
) -> DataFrame:
    """Exclusive running total of ``n`` along ``seq`` within ``group``: ``group, seq, offset``.

    Sums run over chunks of consecutive positions first and over chunk totals second,
    so a group with millions of positions is not summed by one task row by row.
    """
    placed = counts.withColumn("_chunk", F.floor(F.col(seq) / chunk))
    inside = Window.partitionBy(group, "_chunk").orderBy(seq).rowsBetween(Window.unboundedPreceding, -1)
    across = Window.partitionBy(group).orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    totals = placed.groupBy(group, "_chunk").agg(F.sum(n).alias("_total"))
    before = totals.withColumn("_before", F.coalesce(F.sum("_total").over(across), F.lit(0))).drop("_total")
    return (
        placed.withColumn("_within", F.coalesce(F.sum(n).over(inside), F.lit(0)))
        .join(before, [group, "_chunk"])
        .select(group, seq, (F.col("_before") + F.col("_within")).alias("offset"))
    )
