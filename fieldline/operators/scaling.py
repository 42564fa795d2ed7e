"""Filling gaps and scaling columns of the feature table."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.feature import SQLTransformer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fieldline import fixed
from fieldline.functions.vectors import cells_from, cells_from_sql, least_kept, least_kept_sql


def numeric_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, T.NumericType)]


def impute(
    df: DataFrame,
    mean_of: Sequence[str] = tuple(fixed.MEAN_FILLED),
    keep_null: Sequence[str] = (),
    by: Sequence[str] = (),
) -> DataFrame:
    """Column mean for ``mean_of``, 0 for every other number.

    The means come from one scalar subquery over the whole table, or from the
    row's own group if ``by`` is given; a group without any value gets 0. Give
    a stored table: it is read once for the means and once for the rows.
    """
    zeros = [c for c in numeric_columns(df) if c not in {*mean_of, *keep_null, *by}]
    means = F.expr("struct(" + ", ".join(f"avg(`{c}`) AS `{c}`" for c in mean_of) + ") AS _means")
    if by:
        groups = df.groupBy(*by).agg(means).select(F.struct(*by).alias("_group"), "_means")
        beside = df.join(groups, F.struct(*[df[c] for c in by]).eqNullSafe(groups["_group"]), "left").drop("_group")
    else:
        beside = df.withColumn("_means", df.agg(means).scalar())
    last = "0D" if by else "NULL"
    filled = {c: F.expr(f"coalesce(`{c}`, _means.`{c}`, {last})") for c in mean_of}
    return beside.withColumns(filled).drop("_means").na.fill(0, zeros)


def fitted_fill(
    df: DataFrame, mean_of: Sequence[str] = tuple(fixed.MEAN_FILLED), keep_null: Sequence[str] = ()
) -> SQLTransformer:
    """``impute`` as a fitted stage: it holds the means of ``df`` and fills any table of these columns with them."""
    zeros = [c for c in numeric_columns(df) if c not in {*mean_of, *keep_null}]
    means = df.agg(*[F.avg(c).alias(c) for c in mean_of]).first().asDict()  # one number per column
    value = {c: "NULL" if means[c] is None else f"{means[c]!r}D" for c in mean_of} | dict.fromkeys(zeros, "0")
    columns = [f"coalesce(`{c}`, {value[c]}) AS `{c}`" if c in value else f"`{c}`" for c in df.columns]
    return SQLTransformer(statement=f"SELECT {', '.join(columns)} FROM __THIS__")


def top_cells_stage(columns: Sequence[str], keep: int = 3) -> SQLTransformer:
    """``keep_top_cells`` as a stage for tables of these columns."""
    others = ", ".join(f"`{c}`" for c in columns if c not in fixed.CELLS)
    ranked = f"SELECT *, {least_kept_sql(keep=keep)} AS _least FROM __THIS__"
    return SQLTransformer(statement=f"SELECT {others}, {', '.join(cells_from_sql('_least'))} FROM ({ranked})")


def min_max_scale(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Scale columns to [0, 1] over the table; a constant column becomes 0."""
    bounds = ", ".join(f"min(`{c}`) AS `lo_{c}`, max(`{c}`) AS `hi_{c}`" for c in columns)
    found = df.agg(F.expr(f"struct({bounds}) AS b")).scalar()
    scaled = {}
    for c in columns:
        share = f"try_divide(`{c}` - _bounds.`lo_{c}`, _bounds.`hi_{c}` - _bounds.`lo_{c}`)"
        scaled[c] = F.expr(f"CASE WHEN `{c}` IS NOT NULL THEN coalesce({share}, 0D) END")
    return df.withColumn("_bounds", found).withColumns(scaled).drop("_bounds")


def keep_top_cells(df: DataFrame, keep: int = 3) -> DataFrame:
    """Zero all but the ``keep`` most visited cells of each row."""
    others = [c for c in df.columns if c not in fixed.CELLS]
    ranked = df.withColumn("_least", least_kept(keep=keep))
    return ranked.select(*others, *cells_from("_least"))
