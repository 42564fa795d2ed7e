"""Repeated passages: every byte covered by a string of LENGTH bytes that also starts anywhere else goes.

Prefix-free parsing makes this fit a cluster. A rolling hash over GRAM bytes
sets triggers: every window of LENGTH bytes is parsed at the least hash among
its first REACH positions, so that equal windows are parsed at the same place
wherever they stand. Consecutive windows with one trigger form a phrase; its
content (the phrase and the parse that follows, to the depth of LENGTH bytes)
is a dictionary word, kept as hashes of 128 bits. A word that occurs twice
settles all its windows at once, without touching their bytes. What remains are
phrases at the edges of repeats: trigger and the LENGTH - REACH bytes after it
occur elsewhere with other surroundings. Only their windows are taken one by one.

Of the suffix order of dictionary and parse only the neighbourhood to a depth of
LENGTH bytes is needed, that is, which suffixes share their first LENGTH bytes.
It is had by bringing equal hashes of that depth together; the order among
unequal suffixes, for which all bytes would have to be shuffled, is not formed.

Texts are named by 128 bits of their hash, so equal texts are parsed once per
task and share their result. Each task merges equal words before the shuffle: a
passage that a third of the corpus holds gives one row per task.

Defined results: null and empty texts have no bytes and lose none; repeated
rows count as copies of each other; texts under LENGTH bytes lose nothing; an
empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections import Counter

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fieldline.llm.batches import gathered, map_batches, texts_of
from fieldline.session import discard, materialise

LENGTH = 400
# Longer: fewer phrases, but fewer bytes after a trigger (LENGTH - REACH) that all its windows share.
REACH = 200
GRAM = 16
CHUNK_BYTES = 32 << 20

_ODD = np.uint64(0x9E3779B97F4A7C15)


def _signed(values) -> np.ndarray:
    return np.array(values, dtype=np.uint64).view(np.int64)


def rolling(data: np.ndarray, gram: int = GRAM) -> np.ndarray:
    """A hash of the ``gram`` bytes from each position; ``gram`` is a power of two."""
    h, width = data.astype(np.uint64) + np.uint64(1), 1
    while width < gram:
        factor = np.uint64(pow(int(_ODD), width, 1 << 64))
        h = h[:-width] * factor + h[width:]
        width *= 2
    h ^= h >> np.uint64(29)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    return h


def parse(text: bytes, length: int = LENGTH, reach: int = REACH) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Phrases of one text: first window, last window, trigger. Every window is in one phrase."""
    windows = len(text) - length + 1
    if windows < 1:
        empty = np.zeros(0, dtype=np.int64)
        return empty, empty, empty
    h = rolling(np.frombuffer(text, dtype=np.uint8))[: windows + reach - 1]
    # Least hash of each window's first positions, the leftmost of equal ones.
    keyed = (h & np.uint64(0xFFFFFFFF00000000)) | np.arange(len(h), dtype=np.uint64)
    blocks = -(-len(keyed) // reach)
    padded = np.full(blocks * reach, np.iinfo(np.uint64).max, dtype=np.uint64)
    padded[: len(keyed)] = keyed
    square = padded.reshape(blocks, reach)
    ahead = np.minimum.accumulate(square, axis=1).reshape(-1)
    behind = np.minimum.accumulate(square[:, ::-1], axis=1)[:, ::-1].reshape(-1)
    triggers = (np.minimum(behind[:windows], ahead[reach - 1 : reach - 1 + windows]) & np.uint64(0xFFFFFFFF)).astype(np.int64)
    first = np.flatnonzero(np.append(True, triggers[1:] != triggers[:-1]))
    last = np.append(first[1:], windows) - 1
    return first, last, triggers[first]


def words_of(text: bytes, length: int = LENGTH, reach: int = REACH) -> tuple[np.ndarray, ...]:
    """(first, last, context, word) of each phrase: hashes of the bytes after the trigger, and of all bytes of its windows."""
    first, last, trigger = parse(text, length, reach)
    view, digest = memoryview(text), xxhash.xxh3_64_intdigest
    context = np.array([digest(view[t : t + length - reach]) for t in trigger.tolist()], dtype=np.uint64)
    word = np.array([digest(view[a : b + length], 7) for a, b in zip(first.tolist(), last.tolist())], dtype=np.uint64)
    return first, last, context, word


def _names(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    whole = [xxhash.xxh3_128_intdigest(t) for t in texts]
    return _signed([w >> 64 for w in whole]), _signed([w & 0xFFFFFFFFFFFFFFFF for w in whole])


def _span(first: np.ndarray, last: np.ndarray) -> np.ndarray:
    return (first.astype(np.int64) << 32) | last.astype(np.int64)


_NAME = [T.StructField("h1", T.LongType()), T.StructField("h2", T.LongType())]
_PHRASES = T.StructType(
    [T.StructField("context", T.LongType()), T.StructField("word", T.LongType()), *_NAME, T.StructField("span", T.LongType()), T.StructField("held", T.IntegerType())]
)


def _phrases(docs: DataFrame) -> DataFrame:
    """Dictionary words of each chunk of text, once each (held: 1, or 2 for more), and runs of phrases settled by the chunk itself (held: 3)."""

    def run(batches):
        for batch in gathered(batches, CHUNK_BYTES):
            copies = Counter(t for t in texts_of(batch.column(0)) if t and len(t) >= LENGTH)
            if not copies:
                continue
            texts = list(copies)
            h1, h2 = _names(texts)
            parts = [words_of(t) for t in texts]
            sizes = np.array([len(p[0]) for p in parts])
            first, last, context, word = (np.concatenate([p[k] for p in parts]) for k in range(4))
            text = np.repeat(np.arange(len(texts)), sizes)
            many = np.repeat(np.array(list(copies.values())), sizes)
            order = np.lexsort((word, context))
            new = np.ones(len(order), dtype=bool)
            new[1:] = (np.diff(context[order]) != 0) | (np.diff(word[order]) != 0)
            begins = np.flatnonzero(new)
            held = np.add.reduceat(many[order], begins)
            one = order[begins]
            # Runs of phrases that are settled here, as one interval each.
            settled = np.zeros(len(order), dtype=bool)
            settled[order] = np.repeat(held > 1, np.diff(np.append(begins, len(order))))
            at = np.flatnonzero(settled)
            opens = np.ones(len(at), dtype=bool)
            opens[1:] = (np.diff(text[at]) != 0) | (np.diff(at) != 1)
            closes = np.append(opens[1:], True) if len(at) else opens
            runs, own = _span(first[at[opens]], last[at[closes]]), text[at[opens]]
            apart = (h1[own] ^ runs) * np.int64(0x2545F4914F6CDD1D)  # a key of its own, so that runs are dealt evenly
            columns = (
                np.concatenate([context[one].view(np.int64), apart]),
                np.concatenate([word[one].view(np.int64), h2[own]]),
                np.concatenate([h1[text[one]], h1[own]]),
                np.concatenate([h2[text[one]], h2[own]]),
                np.concatenate([_span(first[one], last[one]), runs]),
                np.concatenate([np.minimum(held, 2), np.full(len(own), 3)]).astype(np.int32),
            )
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=_PHRASES.names)

    return map_batches(docs.select("text"), run, _PHRASES)


_TEXTS = T.StructType([*_NAME, T.StructField("packed", T.BinaryType())])


def _packed(docs: DataFrame) -> DataFrame:
    """Texts of LENGTH bytes or more by name, compressed for the shuffle, once per chunk."""

    def run(batches):
        pack = zstandard.ZstdCompressor(level=3).compress
        for batch in gathered(batches, CHUNK_BYTES):
            texts = list({t for t in texts_of(batch.column(0)) if t and len(t) >= LENGTH})
            h1, h2 = _names(texts)
            yield pa.RecordBatch.from_arrays([pa.array(h1), pa.array(h2), pa.array([pack(t) for t in texts], pa.binary())], names=_TEXTS.names)

    return map_batches(docs.select("text"), run, _TEXTS)


STEP = 64
_EDGES = T.StructType(
    [
        T.StructField("k1", T.LongType()),
        T.StructField("k2", T.LongType()),
        *_NAME,
        T.StructField("alone", T.BooleanType()),
        T.StructField("ends", T.IntegerType()),
        T.StructField("hashes", T.ArrayType(T.LongType(), False)),
    ]
)


def _edge_windows(text: bytes, first: int, last: int, trigger: int):
    """Windows of one phrase in steps by their distance to the trigger: (key of the bytes all windows of the step share, last window, their hashes, last first)."""
    view = memoryview(text)
    for step in range((trigger - last) // STEP, (trigger - first) // STEP + 1):
        common = trigger - STEP * step
        high, low = min(last, common), max(first, common - STEP + 1)
        key = xxhash.xxh3_128_intdigest(view[common : common - STEP + 1 + LENGTH], step)
        yield key, high, [xxhash.xxh3_64_intdigest(view[p : p + LENGTH], trigger - p) for p in range(high, low - 1, -1)]


def _edges(texts: DataFrame, wanted: DataFrame) -> DataFrame:
    """Hashes of the single windows of the phrases in ``wanted`` (name, spans, alone)."""

    def run(batches):
        for batch in batches:
            rows = []
            names = list(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()))
            for name, packed, marks in zip(names, batch.column(2).to_pylist(), batch.column(3).to_pylist()):
                text = zstandard.decompress(packed)
                first, last, trigger = parse(text)
                alone = {m["span"]: m["alone"] for m in marks}
                for a, b, t, span in zip(first.tolist(), last.tolist(), trigger.tolist(), _span(first, last).tolist()):
                    if span in alone:
                        rows += [(key >> 64, key & 0xFFFFFFFFFFFFFFFF, *name, alone[span], ends, hashes) for key, ends, hashes in _edge_windows(text, a, b, t)]
            if rows:
                k1, k2, h1, h2, single, ends, hashes = zip(*rows)
                flat = pa.array(_signed([h for own in hashes for h in own]))
                offsets = pa.array(np.concatenate(([0], np.cumsum([len(x) for x in hashes]))).astype(np.int32))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(_signed(k1)), pa.array(_signed(k2)), pa.array(h1, pa.int64()), pa.array(h2, pa.int64()), pa.array(single, pa.bool_()), pa.array(ends, pa.int32()), pa.ListArray.from_arrays(offsets, flat)],
                    names=_EDGES.names,
                )

    return map_batches(texts.join(wanted, ["h1", "h2"]).select("h1", "h2", "packed", "marks"), run, _EDGES)


_FOUND = T.StructType(
    [
        *_NAME,
        T.StructField("n_removed", T.LongType()),
        T.StructField("spans", T.ArrayType(T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())]))),
        T.StructField("kept_sha256", T.StringType()),
    ]
)


def removed_spans(n_bytes: int, windows: list[int], length: int = LENGTH) -> list[tuple[int, int]]:
    """Maximal removed runs (start, end) for intervals of repeated window starts, packed as first << 32 | last."""
    edge = np.zeros(n_bytes + 1, dtype=np.int64)
    spans = np.array(windows, dtype=np.int64)
    np.add.at(edge, spans >> 32, 1)
    np.add.at(edge, (spans & 0xFFFFFFFF) + length, -1)
    covered = np.concatenate(([0], (np.cumsum(edge[:-1]) > 0).astype(np.int8), [0]))
    change = np.diff(covered)
    return list(zip(np.flatnonzero(change == 1).tolist(), np.flatnonzero(change == -1).tolist()))


def _found(texts: DataFrame, windows: DataFrame) -> DataFrame:
    def run(batches):
        for batch in batches:
            rows = []
            for packed, spans in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist()):
                text = zstandard.decompress(packed)
                gone = removed_spans(len(text), spans)
                kept, at = hashlib.sha256(), 0
                for a, b in gone:
                    kept.update(text[at:a])
                    at = b
                kept.update(text[at:])
                rows.append((sum(b - a for a, b in gone), [{"start": a, "end": b} for a, b in gone], kept.hexdigest()))
            if rows:
                n, spans, sha = zip(*rows)
                kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(n, pa.int64()), pa.array(spans, kind), pa.array(sha)], names=_FOUND.names)

    return map_batches(texts.join(windows, ["h1", "h2"]).select("h1", "h2", "packed", "spans"), run, _FOUND)


def repeated_windows(docs: DataFrame) -> DataFrame:
    """(h1, h2, spans): for each text with any, the intervals of window starts that occur elsewhere. A stored table."""
    phrases = _phrases(docs)
    # Contexts with more than one word; found first, so that only settled and open phrases are ever stored.
    words = phrases.filter("held < 3").groupBy("context").agg(F.min("word").alias("low"), F.max("word").alias("high"))
    shared = materialise(words.filter("low != high").select("context"), "repeats-contexts")
    word = Window.partitionBy("context", "word")
    numbered = phrases.withColumn("total", F.sum("held").over(word)).withColumn("nth", F.row_number().over(word.orderBy("h1", "h2", "span")))
    settled = numbered.filter("total > 1").select("h1", "h2", "span", F.lit(None).cast("boolean").alias("alone"))
    open_ = numbered.filter("held < 3 and nth = 1").join(shared, "context").select("h1", "h2", "span", (F.col("total") == 1).alias("alone"))
    stored = materialise(settled.unionByName(open_), "repeats-phrases")
    settled = stored.filter("alone is null").select("h1", "h2", "span")
    wanted = stored.filter("alone is not null").groupBy("h1", "h2").agg(F.collect_set(F.struct("span", "alone")).alias("marks"))
    edges = materialise(_edges(_packed(docs), wanted), "repeats-edges")
    # Stored, so that adaptive execution sees plain shuffles on either side of the joins and can split a common passage.
    keys = edges.groupBy("k1", "k2").agg(F.count("*").alias("n")).filter("n > 1").select("k1", "k2")
    keys = materialise(keys, "repeats-keys")
    single = edges.join(keys, ["k1", "k2"]).select("k1", "k2", "h1", "h2", "alone", "ends", F.posexplode("hashes").alias("back", "hash"))
    # Equal texts give equal rows from several tasks; the same window of one text counts once. A window with two
    # places has a least and a greatest one that differ, which tasks can tell before the shuffle.
    window, place = ["k1", "k2", "hash"], F.struct("h1", "h2", F.col("at"))
    places = single.select(*window, "h1", "h2", "alone", (F.col("ends") - F.col("back")).cast("long").alias("at"))
    twice = places.groupBy(*window).agg(F.min(place).alias("low"), F.max(place).alias("high")).filter("low != high").select(*window)
    twice = materialise(twice, "repeats-twice")
    more = places.filter("alone").join(twice, window).select("h1", "h2", F.shiftleft("at", 32).bitwiseOR(F.col("at")).alias("span"))
    found = settled.unionByName(more).groupBy("h1", "h2").agg(F.collect_set("span").alias("spans"))
    out = materialise(found, "repeats-windows")
    discard(shared, stored, edges, keys, twice)
    return out


def removals(docs: DataFrame, text: str = "text") -> DataFrame:
    """(h1, h2, n_removed, spans, kept_sha256) of every distinct text that loses bytes; names by ``named``."""
    narrow = docs.select(F.col(text).alias("text"))
    found = _found(_packed(narrow), repeated_windows(narrow))
    return found.groupBy("h1", "h2").agg(*[F.first(c).alias(c) for c in ("n_removed", "spans", "kept_sha256")])


def named(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, name (h1, h2), n_bytes and SHA-256 of every row's text."""
    schema = T.StructType([T.StructField("doc_id", docs.schema[doc_id].dataType), *_NAME, T.StructField("n_bytes", T.LongType()), T.StructField("sha256", T.StringType())])

    def run(batches):
        for batch in batches:
            texts = [t or b"" for t in texts_of(batch.column(1))]
            h1, h2 = _names(texts)
            sums = [hashlib.sha256(t).hexdigest() for t in texts]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(h1), pa.array(h2), pa.array(list(map(len, texts)), pa.int64()), pa.array(sums, pa.string())], names=schema.names)

    return map_batches(docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")), run, schema)


def remove_repeats(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per input row: doc_id, n_bytes, n_removed, spans (removed byte ranges), kept_sha256."""
    # Stored, so that adaptive execution can split the rows of a text with very many copies.
    rows, gone = named(docs, doc_id, text), materialise(removals(docs, text), "repeats-removals")
    return rows.join(gone, ["h1", "h2"], "left").select(
        "doc_id",
        "n_bytes",
        F.coalesce("n_removed", F.lit(0)).alias("n_removed"),
        F.coalesce("spans", F.array().cast(gone.schema["spans"].dataType)).alias("spans"),
        F.coalesce("kept_sha256", "sha256").alias("kept_sha256"),
    )
