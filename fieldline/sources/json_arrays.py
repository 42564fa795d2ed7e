"""JSON array files, read by byte ranges.

A file that is one JSON array has no line per record, so a task that starts in
the middle of it cannot see where a record begins: a brace may stand inside a
string, and an object inside another. Spark's text source still cuts the file
into byte ranges, at closing braces instead of line ends. Two passes follow:

1. Each task notes what its range does to a reader that comes in outside or
   inside a string: how it leaves, how the depth of open braces changes, and how
   low it gets. These notes, a hundred bytes a range, are put in order per file
   and tell how every range really begins.
2. With that, each task cuts its range into records. Records that lie in one
   range go on where they are; the pieces of those that cross a border, at most
   two a range, are brought together by the range in which they begin.

So no task holds more than a range at a time, and no text is shuffled but
the pieces at borders. Range sizes are those of ``spark.sql.files.maxPartitionBytes``;
a task takes one range after another if ``ranges_of`` bounds the number of tasks.

Records are the objects of the outermost level, of one array or of several
values one after another; other values there are skipped.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from contextlib import contextmanager

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fieldline.session import _file_system

# What a task takes of ranges that are smaller.
TASK_BYTES = 128 << 20

# What is left of a string; it ends with a quotation mark or with the fragment.
_REST = re.compile(r'[^"\\]*(?:\\.[^"\\]*)*(?:(")|\\?\Z)', re.DOTALL)


def opened(fragment: str, in_string: bool) -> tuple[int, bool, int]:
    """(opening braces outside strings, whether it ends in a string, place of the first such brace or -1)."""
    at, opens, first = 0, 0, -1
    if in_string:
        found = _REST.match(fragment)
        if not found[1]:
            return 0, True, -1
        at = found.end()
    while True:
        quote = fragment.find('"', at)
        stop = len(fragment) if quote < 0 else quote
        if braces := fragment.count("{", at, stop):
            if first < 0:
                first = fragment.index("{", at)
            opens += braces
        if quote < 0:
            return opens, False, first
        found = _REST.match(fragment, quote + 1)
        if not found[1]:
            return opens, True, first
        at = found.end()


def _fragments(spark: SparkSession, path: str) -> DataFrame:
    """(file, start, value): text between closing braces, in order within each range of a file."""
    raw = spark.read.option("lineSep", "}").text(path)
    return raw.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"), "value")


def _ranges(batches) -> Iterator[tuple[str, int, list[str]]]:
    """Consecutive fragments of one range, as far as a batch holds them."""
    for batch in batches:
        files, starts, values = (c.to_pylist() for c in batch.columns[:3])
        first = 0
        for i in range(1, len(values) + 1):
            if i == len(values) or starts[i] != starts[first] or files[i] != files[first]:
                yield files[first], starts[first], values[first:i]
                first = i


_NOTES = T.StructType(
    [T.StructField("file", T.StringType()), T.StructField("start", T.LongType())]
    + [T.StructField(f"{name}_{s}", T.LongType()) for s in (0, 1) for name in ("leaves", "change", "least")]
)


def _note(batches):
    """What each range does, for a reader that comes in outside (0) or inside (1) a string."""
    now, states = None, []

    def row():
        return [*now, *[x for s in states for x in s]]

    rows = []
    for file, start, fragments in _ranges(batches):
        if now != (file, start):
            if now:
                rows.append(row())
            now, states = (file, start), [(0, 0, 0), (1, 0, 0)]
        for nth, (inside, depth, least) in enumerate(states):
            for f in fragments:
                opens, inside, _ = opened(f, bool(inside))
                depth += opens - (not inside)
                least = min(least, depth)
            states[nth] = (int(inside), depth, least)
    if now:
        rows.append(row())
    columns = list(zip(*rows)) if rows else [[] for _ in _NOTES.names]
    yield pa.RecordBatch.from_arrays([pa.array(c, pa.string() if n == "file" else pa.int64()) for n, c in zip(_NOTES.names, columns)], names=_NOTES.names)


_BEGINS = T.StructType(
    [T.StructField("file", T.StringType()), T.StructField("start", T.LongType()), T.StructField("inside", T.LongType()), T.StructField("depth", T.LongType()), T.StructField("opener", T.LongType())]
)


def _begin(notes):
    """How every range of one file begins: in a string or not, at which depth, and the range in which its open record began.

    ``notes`` are the ranges of one file, some hundred bytes for each 128 MB of it.
    """
    notes = notes.sort_by("start")
    inside, depth, opener, rows = 0, 0, -1, []
    for n in notes.to_pylist():
        rows.append((n["file"], n["start"], inside, depth, opener))
        if depth + n[f"least_{inside}"] <= 0:  # no record is open at some place, so one that is open at the end began here
            opener = n["start"]
        depth, inside = max(0, depth + n[f"change_{inside}"]), n[f"leaves_{inside}"]
    return pa.Table.from_arrays([pa.array(c) for c in zip(*rows)], schema=pa.schema([("file", pa.string()), *[(x, pa.int64()) for x in ("start", "inside", "depth", "opener")]]))


_PIECES = T.StructType(
    [T.StructField("file", T.StringType()), T.StructField("opener", T.LongType()), T.StructField("start", T.LongType()), T.StructField("whole", T.BooleanType()), T.StructField("value", T.StringType())]
)


def _cut(batches):
    """Records of each range, and the pieces of those that cross its borders."""
    now, held = None, []

    def piece(whole: bool, begun_here: bool) -> tuple:
        text = "".join(held)
        held.clear()
        return (now[0], now[1] if begun_here else opener, now[1], whole, text)

    def packed(rows):
        columns = list(zip(*rows)) if rows else [[] for _ in _PIECES.names]
        kinds = (pa.string(), pa.int64(), pa.int64(), pa.bool_(), pa.string())
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=_PIECES.names)

    inside, depth, opener, here = 0, 0, -1, False
    for batch in batches:
        rows = []
        for file, start, value, in_string, at_depth, began in zip(*(c.to_pylist() for c in batch.columns)):
            if now != (file, start):
                if now and held:
                    rows.append(piece(False, here))
                now, inside, depth, opener, here = (file, start), bool(in_string), at_depth, began, False
            opens, leaves, first = opened(value, inside)
            if depth == 0:
                if first < 0:
                    inside = leaves
                    continue
                value, here = value[first:], True
            held.append(value)
            depth += opens
            inside = leaves
            held.append("}")
            if not inside:
                depth -= 1
                if depth == 0:
                    rows.append(piece(here, here))
                    here = False
        if rows:
            yield packed(rows)
    if now and held:
        yield packed([piece(False, here)])


@contextmanager
def ranges_of(spark: SparkSession, path: str, size: str) -> Iterator[int]:
    """While it lasts, files are read in ranges of ``size``, by a task for every 128 MB of ``path``, and a few per core at least."""
    files, place = _file_system(spark, path)
    tasks = max(4 * spark.sparkContext.defaultParallelism, files.getContentSummary(place).getLength() // TASK_BYTES)
    wanted = {"spark.sql.files.maxPartitionBytes": size, "spark.sql.files.maxPartitionNum": str(tasks)}
    before = {key: spark.conf.get(key, None) for key in wanted}
    for key, value in wanted.items():
        spark.conf.set(key, value)
    try:
        yield tasks
    finally:
        for key, value in before.items():
            spark.conf.unset(key) if value is None else spark.conf.set(key, value)


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """The text of each record of the JSON array files at ``path``, in a column ``value``."""
    notes = _fragments(spark, path).mapInArrow(_note, _NOTES)
    begins = notes.groupBy("file").applyInArrow(_begin, _BEGINS)
    # One row per range: under a thousandth of a thousandth of the text.
    placed = _fragments(spark, path).join(F.broadcast(begins), ["file", "start"])
    pieces = placed.select("file", "start", "value", "inside", "depth", "opener").mapInArrow(_cut, _PIECES)
    crossing = (
        pieces.filter("NOT whole").groupBy("file", "opener")
        .agg(F.array_sort(F.collect_list(F.struct("start", "value"))).alias("parts"))
        .select(F.array_join(F.col("parts.value"), "").alias("value"))
    )
    return pieces.filter("whole").select("value").unionByName(crossing)


def read_array(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """JSON array files as rows of ``schema``; a record that does not fit it is an error."""
    return read_records(spark, path).select(F.from_json("value", schema, {"mode": "FAILFAST"}).alias("record")).select("record.*")


def write_arrays(df: DataFrame, path: str, files: int | None = None) -> None:
    """``df`` as JSON arrays, one file per partition, or so many ``files``.

    With ``files``, records become text in the tasks of ``df``; those that write
    a file only put marks between them, some records at a time.
    """

    def run(batches):
        mark = "["
        for batch in batches:
            if len(batch):
                marks = pa.array([mark, *[","] * (len(batch) - 1)], batch.column(0).type)
                yield pa.RecordBatch.from_arrays([pc.binary_join_element_wise(marks, batch.column(0), "")], names=["value"])
                mark = ","
        yield pa.RecordBatch.from_arrays([pa.array(["]" if mark == "," else "[]"], pa.string())], names=["value"])

    text = df.select(F.to_json(F.struct(*df.columns)).alias("value"))
    (text if files is None else text.repartition(files)).mapInArrow(run, "value string").write.text(path)
