"""Row checks against a target schema and run-level quality gates."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F, types as T

from ..functions.coerce import check_typed, check_value
from ..functions.text import is_blank, percent
from ..model import ExtractionTarget

NULL_RATE_LIMIT = 0.5

_KIND_OF_TYPE = {
    T.LongType: "int", T.IntegerType: "int", T.DoubleType: "float", T.FloatType: "float",
    T.BooleanType: "bool", T.StringType: "str",
}


def _value_and_kind(rows: DataFrame, field: str) -> tuple[Column, Column]:
    """Text and kind of a raw field: a typed column, a tagged struct, or no column at all."""
    if field not in rows.columns:
        return F.lit(None).cast("string"), F.lit("absent")
    dtype = rows.schema[field].dataType
    if isinstance(dtype, T.StructType):
        return F.col(field)["v"], F.col(field)["k"]
    return F.col(field).cast("string"), F.lit(_KIND_OF_TYPE[type(dtype)])


def _plain_type(rows: DataFrame, field: str) -> str | None:
    """The kind of a typed column."""
    return _KIND_OF_TYPE.get(type(rows.schema[field].dataType)) if field in rows.columns else None


def check_rows(rows: DataFrame, target: ExtractionTarget, keys: tuple[str, ...]) -> DataFrame:
    """Type every row: ``keys``, the item columns, ``valid``, ``errors`` and ``nulls``.

    ``errors`` is an array of (field, message) in schema order; ``nulls`` says per
    field, in schema order, whether the raw value was missing or blank. Columns that
    are not item fields are dropped. A datetime field gives an instant column and an
    ISO text column ``<name>_iso`` that keeps the offset as written.
    """
    checks, nulls = [], []
    for field in target.fields:
        plain = _plain_type(rows, field.name)
        v, kind = _value_and_kind(rows, field.name)
        own = field.kind in ("str", "int") and plain == field.kind
        checks.append((check_typed(field, F.col(field.name)) if own else check_value(field, v, kind)).alias(field.name))
        nulls.append(F.col(field.name).isNull() if plain == "int" else is_blank(v))
    # Exploding a list of one keeps the checks a value: a plain struct is inlined, and each check run again, wherever a part of it is read.
    judged = rows.select(*keys, F.array(*nulls).alias("nulls"), F.explode(F.array(F.struct(*checks))).alias("_c"))
    columns, errors = [], []
    for field in target.fields:
        c = F.col("_c")[field.name]
        if field.kind == "datetime":
            columns += [c["stamp"].alias(field.name), c["value"].alias(f"{field.name}_iso")]
        else:
            columns.append(c["value"].alias(field.name))
        errors.append(
            F.when(c["error"].isNotNull(), F.struct(F.lit(field.name).alias("field"), c["error"].alias("message")))
        )
    typed = judged.select(*keys, *columns, F.array_compact(F.array(*errors)).alias("errors"), "nulls")
    return typed.withColumn("valid", F.size("errors") == 0)


def item_columns(target: ExtractionTarget) -> list[str]:
    """Output columns of an item, in schema order."""
    return [c for f in target.fields for c in ([f.name, f"{f.name}_iso"] if f.kind == "datetime" else [f.name])]


def valid_rows(checked: DataFrame, target: ExtractionTarget, keys: tuple[str, ...]) -> DataFrame:
    return checked.where("valid").select(*keys, *item_columns(target))


def rejected_rows(checked: DataFrame, target: ExtractionTarget, keys: tuple[str, ...]) -> DataFrame:
    """Rows that fail the schema, with their errors: the dead-letter table."""
    return checked.where(~F.col("valid")).select(*keys, *item_columns(target), "errors")


def row_errors(checked: DataFrame, keys: tuple[str, ...], row_no: str = "row_no") -> DataFrame:
    """One line per failed check: ``keys, row_no, err_no, field, message``."""
    lines = checked.where(~F.col("valid")).select(
        *keys, row_no, F.posexplode("errors").alias("err_no", "e")
    )
    return lines.select(
        *keys, row_no, "err_no", F.col("e.field").alias("field"),
        F.format_string("%s[%d]: %s", F.col("e.field"), F.col(row_no), F.col("e.message")).alias("message"),
    )


def _floor_message(target: ExtractionTarget) -> Column:
    return F.format_string(f"min_rows: %d of {target.floor}", F.col("valid_count"))


def _null_message(field: str, limit: float) -> Column:
    return F.concat(F.lit(f"null_rate {field}: "), percent(F.col("null_rates")[field]), F.lit(" over "), percent(F.lit(limit)))


def run_quality(
    checked: DataFrame,
    runs: DataFrame,
    target: ExtractionTarget,
    run_keys: tuple[str, ...],
    limit: float = NULL_RATE_LIMIT,
) -> DataFrame:
    """One verdict per run, also for runs without any row.

    ``run_keys, n_rows, valid_count, n_row_errors, null_rates, gate_errors, n_errors,
    floor_ok, null_ok, ok``. Row errors stay in their own table (``row_errors``): their
    number has no bound, so only their count is carried here.
    """
    names = [f.name for f in target.fields]
    sums = checked.groupBy(*run_keys).agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.count_if("valid").alias("valid_count"),
        F.sum(F.size("errors")).alias("n_row_errors"),
        *[F.count_if(F.col("nulls")[i]).alias(f"_null_{i}") for i in range(len(names))],
    )
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("bigint")
    rates = [
        c
        for i, name in enumerate(names)
        for c in (F.lit(name), F.coalesce(F.col(f"_null_{i}") / F.col("n_rows"), F.lit(1.0)))
    ]
    joined = runs.select(*run_keys).distinct().join(sums, list(run_keys), "left").select(
        *run_keys, zero("n_rows").alias("n_rows"), zero("valid_count").alias("valid_count"),
        zero("n_row_errors").alias("n_row_errors"), F.create_map(*rates).alias("null_rates"),
    )
    too_null = {
        f: (F.col("null_rates")[f] > limit) if f in names else F.lit(1.0 > limit) for f in target.required_fields
    }
    floor_ok = F.col("valid_count") >= target.floor
    gates = [F.when(~floor_ok, _floor_message(target))]
    gates += [F.when(too_null[f], _null_message(f, limit)) for f in target.required_fields]
    null_ok = ~reduce(lambda a, b: a | b, too_null.values(), F.lit(False))
    return joined.select(
        "*",
        F.array_compact(F.array(*gates)).alias("gate_errors"),
        floor_ok.alias("floor_ok"),
        null_ok.alias("null_ok"),
        (floor_ok & null_ok).alias("ok"),
    ).withColumn("n_errors", F.col("n_row_errors") + F.size("gate_errors"))
