"""Readers: event logs, dimension files, feature tables, measure folders."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fieldline.functions import events as ev
from fieldline.schema import (
    GROUP,
    MATCH_SCHEMA,
    PLAYER_NAME_SCHEMA,
    PLAYER_SCHEMA,
    TEAM_SCHEMA,
    event_schema,
)
from fieldline.sources import json_arrays

NO_SUBTYPE = -1


def read_json_table(spark: SparkSession, path: str, schema: T.StructType, layout: str = "array") -> DataFrame:
    """JSON with a given schema.

    ``layout='array'`` reads files that hold one JSON array each; such a file
    cannot be split, which suits the small dimension files. ``'lines'`` reads
    one object per line and fails on anything else, instead of giving empty rows.
    """
    if layout not in ("array", "lines"):
        raise ValueError("layout is 'array' or 'lines'")
    read = spark.read.schema(schema).option("multiLine", layout == "array")
    return (read.option("mode", "FAILFAST") if layout == "lines" else read).json(path)


def read_events(
    spark: SparkSession,
    path: str,
    fmt: str = "json",
    layout: str = "lines",
    team_type: T.DataType | None = None,
    match_id: int | None = None,
) -> DataFrame:
    """Event log in the model's shape, from JSON or parquet.

    ``layout='lines'`` reads one object per line, ``'array'`` files that hold one
    JSON array each; both are cut into byte ranges (see ``json_arrays``).
    ``match_id`` is for files of a single match, which carry no match column.
    """
    schema = event_schema(team_type or T.LongType())
    if fmt == "json":
        raw = json_arrays.read_array(spark, path, schema) if layout == "array" else read_json_table(spark, path, schema, layout)
    elif fmt == "parquet":
        raw = spark.read.parquet(path)
    else:
        raise ValueError("fmt is 'json' or 'parquet'")
    if match_id is not None:
        raw = raw.withColumn("matchId", F.lit(match_id).cast("bigint"))
    return normalise_events(raw)


def normalise_events(raw: DataFrame) -> DataFrame:
    """Flatten tags and positions of raw events.

    Adds first and second point, the two-position flag, grid cell and angle.
    Nothing is computed for columns that a query does not use.
    """
    sub = F.col("subEventId")
    if isinstance(raw.schema["subEventId"].dataType, T.StringType):
        sub = F.when(sub == "", F.lit(NO_SUBTYPE).cast("bigint")).otherwise(sub.try_cast("bigint"))
    point = {
        name: ev.nan_to_null(ev.coordinate(axis, index))
        for name, axis, index in [("x", "x", 0), ("y", "y", 0), ("x_end", "x", 1), ("y_end", "y", 1)]
    }
    flat = raw.withColumns(
        {
            "subEventId": sub,
            "tags": ev.tag_ids(),
            "has_doublepos": ev.has_two_positions(),
            **point,
        }
    )
    return with_cells(flat).withColumn(
        "angle",
        F.when(F.col("has_doublepos"), ev.move_angle(F.col("x"), F.col("y"), F.col("x_end"), F.col("y_end"))),
    )


def with_cells(events: DataFrame) -> DataFrame:
    """(Re)compute the grid cell from ``x`` and ``y``."""
    return events.withColumns(
        {"numero_cella_x": ev.grid_cell(F.col("x")), "numero_cella_y": ev.grid_cell(F.col("y"))}
    )


def read_players(spark: SparkSession, path: str, layout: str = "array") -> DataFrame:
    return read_json_table(spark, path, PLAYER_SCHEMA, layout)


def read_teams(spark: SparkSession, path: str, layout: str = "array") -> DataFrame:
    return read_json_table(spark, path, TEAM_SCHEMA, layout)


def read_matches(spark: SparkSession, path: str, layout: str = "array") -> DataFrame:
    return read_json_table(spark, path, MATCH_SCHEMA, layout)


def read_player_names(spark: SparkSession, path: str, layout: str = "array") -> DataFrame:
    return read_json_table(spark, path, PLAYER_NAME_SCHEMA, layout)


def _typed(name: str, text_columns: Sequence[str]) -> Column:
    """Text cell to its type: ids are whole numbers that may read '114.0'."""
    value = F.col(f"`{name}`")
    if name in text_columns:
        return value.alias(name)
    number = ev.nan_to_null(value.try_cast("double"))
    return (number.cast("bigint") if name in ("playerId", "matchId", "wyId") else number).alias(name)


def read_feature_csv(
    spark: SparkSession, path: str, text_columns: Sequence[str] = ("matchPeriod",), index_column: bool = True
) -> DataFrame:
    """CSV with a header; a leading index column without a name is dropped."""
    raw = spark.read.option("header", True).csv(path)
    if index_column:
        raw = raw.drop("_c0")
    return raw.select(*[_typed(c, text_columns) for c in raw.columns])


def read_measure_folder(spark: SparkSession, folder: str) -> dict[str, DataFrame]:
    """Every CSV of a folder as a table named after its file.

    An unnamed first column is an index and is dropped. A column called '0'
    holds the player and an unnamed second one the measure named by the file.
    """
    listing = spark.read.format("binaryFile").option("pathGlobFilter", "*.csv").load(folder).select("path")
    tables = {}
    for path in sorted(row.path for row in listing.collect()):  # one entry per measure file
        stem = path.rsplit("/", 1)[-1][: -len(".csv")]
        raw = spark.read.option("header", True).csv(path).drop("_c0")
        if "0" in raw.columns:
            raw = raw.withColumnsRenamed({"0": "playerId", "_c1": stem})
        tables[stem] = raw.select(*[_typed(c, ("matchPeriod",)) for c in raw.columns])
    return tables


# A comma outside quotation marks.
_COMMA = r',(?=(?:[^"]*"[^"]*")*[^"]*$)'
MEASURE_KEYS = ("matchId", "playerId", "matchPeriod")


def _measure_lines(spark: SparkSession, folder: str) -> DataFrame:
    """(file, source, cells, is_header) of every line of the CSV files below a folder, from one scan.

    The source is the file's name; a folder ``name.csv`` of part files counts as
    one file. A line is a header if it names the player's column.
    """
    lines = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "*.csv").text(folder)
    path = F.url_decode(F.col("_metadata.file_path"))
    quoted = F.transform(F.split("value", _COMMA, -1), lambda c: F.regexp_replace(F.trim(c), '^"|"$', ""))
    # A line without quotation marks, as nearly all are, needs no look at what follows each comma.
    cells = F.when(F.contains("value", F.lit('"')), quoted).otherwise(F.transform(F.split("value", ",", -1), lambda c: F.trim(c)))
    named = lines.select(
        path.alias("file"), F.regexp_extract(path, r"([^/]+)\.csv(?:/part-[^/]*)?$", 1).alias("source"), cells.alias("cells")
    ).filter("size(cells) > 1")
    is_header = F.array_contains("cells", "playerId") | ((F.col("cells")[0] == "") & F.array_contains("cells", "0"))
    return named.withColumn("is_header", is_header)


def _header_names(source: Column, cells: Column) -> Column:
    """Column names of a header; the index column has none, a column '0' is the player and the unnamed one beside it the measure of the file."""
    of_player = F.array_contains(cells, "0")
    return F.transform(
        cells,
        lambda c, i: F.when(of_player & (c == "0"), "playerId").when(of_player & (c == "") & (i > 0), source).otherwise(c),
    )


def read_measures(spark: SparkSession, folder: str) -> tuple[DataFrame, dict[str, tuple[str, ...]]]:
    """All measures of a folder as rows (source, keys..., level, name, value), and the keys of each measure.

    All files are read in one scan, whose plan does not grow with their number.
    The headers, one line per file, are read first: a measure's name becomes a
    column later, and columns have to be known by then.
    """
    lines = _measure_lines(spark, folder)
    header = F.struct("file", "source", _header_names(F.col("source"), F.col("cells")).alias("names"))
    found = [r["h"] for r in lines.filter("is_header").select(header.alias("h")).distinct().collect()]  # one per file
    keys_of: dict[str, tuple[str, ...]] = {}
    for h in found:
        keys = tuple(k for k in MEASURE_KEYS if k in h["names"])
        for name in h["names"]:
            if name and name not in MEASURE_KEYS and keys_of.setdefault(name, keys) != keys:
                raise ValueError(f"measure {name} is keyed in two ways")
    headers = F.broadcast(spark.createDataFrame([(h["file"], h["names"]) for h in found], "file string, names array<string>"))
    rows = lines.filter("NOT is_header").join(headers, "file")
    cell = lambda k: F.try_element_at("cells", F.array_position("names", k).cast("int"))
    key = {
        k: F.when(F.array_contains("names", k), cell(k) if k == "matchPeriod" else ev.nan_to_null(cell(k).try_cast("double")).cast("bigint"))
        for k in MEASURE_KEYS
    }
    cells = F.filter(F.arrays_zip("names", "cells"), lambda c: (c["names"] != "") & ~c["names"].isin(*MEASURE_KEYS))
    level = F.filter(F.array(*[F.lit(k) for k in MEASURE_KEYS]), lambda k: F.array_contains("names", k))
    tall = rows.select("source", *[v.alias(k) for k, v in key.items()], level.alias("level"), F.explode(cells).alias("cell"))
    value = ev.nan_to_null(F.col("cell.cells").try_cast("double"))
    return tall.select("source", *MEASURE_KEYS, "level", F.col("cell.names").alias("name"), value.alias("value")), keys_of


def keyed_on(tables: Mapping[str, DataFrame], keys: Sequence[str] = tuple(GROUP)) -> dict[str, DataFrame]:
    """The tables that carry all of ``keys``."""
    return {name: t for name, t in tables.items() if set(keys) <= set(t.columns)}
