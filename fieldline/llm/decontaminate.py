"""Benchmark decontamination with suffix arrays of the training text.

Each task turns a shard of documents (about SHARD_BYTES of text) into word
numbers and sorts the suffixes that could match into a suffix array; every
suffix of every benchmark item is looked up in it by binary search. A window is
ten consecutive words of an item (or a whole shorter item); matched windows on
one diagonal are joined into longest verbatim matches with their places.
Documents never move: the benchmark is sent to the shards, in blocks of at most
BLOCK_WORDS words, so a benchmark of any size needs bounded memory.

Defined results: null, empty and wordless texts have no words and are clean;
items without words match nothing; equal items are searched once and all
reported; a null item_id is reported as "null"; repeated document rows each get
their own result; empty tables give empty or clean results; other columns are
not read, or kept as they are by ``remove_contaminated``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fieldline.llm.batches import gathered, map_batches, texts_of

WINDOW = 10
SHARD_BYTES = 16 << 20
BLOCK_WORDS = 1_000_000

# A-Z to a-z; what separates words to a space; digits, a-z and bytes of other characters stay.
_FOLD = bytes(
    b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256)
)

MATCHES = T.StructType(
    [
        T.StructField("n_words", T.LongType()),
        T.StructField("n_hit", T.LongType()),
        T.StructField("item_ids", T.ArrayType(T.StringType())),
        T.StructField("spans", T.ArrayType(T.StructType([T.StructField("start", T.IntegerType()), T.StructField("n_words", T.IntegerType())]))),
        T.StructField("longest", T.IntegerType()),
    ]
)


def words_of(text: bytes | None) -> list[bytes]:
    return text.translate(_FOLD).split() if text else []


class Block:
    """Benchmark items as sorted windows over numbered words. Plain arrays, sent to the tasks."""

    def __init__(self, items: dict[tuple[bytes, ...], list[str]], window: int):
        self.window = window
        self.vocabulary: dict[bytes, int] = {}
        number = self.vocabulary
        rows, lengths, owners, places = [], [], [], []
        self.item_ids: list[list[str]] = []
        for words, ids in items.items():
            codes = [number.setdefault(w, len(number) + 1) for w in words]
            text = len(self.item_ids)
            self.item_ids.append(ids)
            size = min(window, len(codes))
            for at in range(len(codes) - size + 1):
                rows.append(codes[at : at + size] + [0] * (window - size))
                lengths.append(size)
                owners.append(text)
                places.append(at)
        table = np.array(rows, dtype=np.uint32).reshape(-1, window)
        sizes = np.array(lengths, dtype=np.int64)
        keys = _keys(table)
        # Equal windows are looked up once; their owners are kept as runs.
        self.order = np.argsort(keys, kind="stable")
        _, first = np.unique(keys[self.order], return_index=True)
        self.first = np.append(first, len(keys))
        unique = self.order[first]
        self.low, self.sizes = keys[unique], sizes[unique]
        high = table[unique].copy()
        for short in range(1, window):
            high[self.sizes == short, short:] = 0xFFFFFFFF
        self.high = _keys(high)
        self.owners, self.places = np.array(owners, dtype=np.int64), np.array(places, dtype=np.int64)
        self.pairs = np.unique(_pair(table[:, 0], table[:, 1])[sizes > 1]) if window > 1 else np.zeros(0, np.uint64)
        self.singles = np.unique(table[sizes == 1, 0])


def _keys(table: np.ndarray) -> np.ndarray:
    """Rows of word numbers as byte strings that sort like the rows."""
    raw = np.ascontiguousarray(table.astype(">u4"))
    return raw.view(f"S{4 * table.shape[1]}").reshape(-1)


def _pair(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return (a.astype(np.uint64) << np.uint64(32)) | b.astype(np.uint64)


def _among(values: np.ndarray, ordered: np.ndarray) -> np.ndarray:
    if not len(ordered):
        return np.zeros(len(values), dtype=bool)
    at = np.searchsorted(ordered, values)
    at[at == len(ordered)] = 0
    return ordered[at] == values


def search(codes: np.ndarray, block: Block) -> tuple[np.ndarray, np.ndarray]:
    """(position, window) of every occurrence; ``codes`` ends in ``block.window`` zeros and has 0 between documents.

    The suffix array holds the suffixes that begin like some window; no other
    suffix can match one.
    """
    size = len(codes) - block.window
    starts = np.flatnonzero(codes[:size])
    begins = _among(_pair(codes[starts], codes[starts + 1]), block.pairs) | _among(codes[starts], block.singles)
    starts = starts[begins]
    keys = _keys(codes[starts[:, None] + np.arange(block.window)])
    suffixes = np.argsort(keys, kind="stable")
    keys = keys[suffixes]
    low, high = np.searchsorted(keys, block.low, "left"), np.searchsorted(keys, block.high, "right")
    counts = high - low
    windows = np.repeat(np.arange(len(counts)), counts)
    inside = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)
    return starts[suffixes[np.repeat(low, counts) + inside]], windows


def _owned(windows: np.ndarray, block: Block) -> tuple[np.ndarray, np.ndarray]:
    """For each window its owners: (index into ``windows``, index into ``block.owners``)."""
    counts = block.first[windows + 1] - block.first[windows]
    which = np.repeat(np.arange(len(windows)), counts)
    inside = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)
    return which, block.order[np.repeat(block.first[windows], counts) + inside]


def match_shard(texts: list[bytes | None], blocks: Iterator[Block]) -> list[tuple]:
    """The fields of MATCHES for each text."""
    words = [words_of(t) for t in texts]
    counts = np.fromiter(map(len, words), np.int64, len(words))
    starts = np.cumsum(counts + 1) - counts - 1
    size = int(counts.sum() + len(words))
    hit = np.zeros(size, dtype=bool)
    items: dict[int, set[str]] = {}
    longest = np.zeros(len(words), dtype=np.int64)
    for block in blocks:
        get = block.vocabulary.get
        codes = np.zeros(size + block.window, dtype=np.uint32)
        at = 0
        for own in words:
            if own:
                codes[at : at + len(own)] = [get(w, 0) for w in own]
            at += len(own) + 1
        position, window = search(codes, block)
        if not len(position):
            continue
        cover = np.zeros(size + block.window + 1, dtype=np.int32)
        np.add.at(cover, position, 1)
        np.add.at(cover, position + block.sizes[window], -1)
        hit |= np.cumsum(cover)[:size] > 0
        doc = np.searchsorted(starts, position, "right") - 1
        # Items, from each distinct pair of document and window.
        pairs = np.unique(doc * len(block.sizes) + window)
        which, owned = _owned(pairs % len(block.sizes), block)
        for d, text in np.unique(np.stack([pairs[which] // len(block.sizes), block.owners[owned]], axis=1), axis=0).tolist():
            items.setdefault(d, set()).update(block.item_ids[text])
        # Longest matches: windows that follow each other in both texts.
        which, owned = _owned(window, block)
        text, place, position, doc = block.owners[owned], block.places[owned], position[which], doc[which]
        order = np.lexsort((position, position - place, text, doc))
        text, diagonal, position, doc = text[order], (position - place)[order], position[order], doc[order]
        span = block.sizes[window][which][order]
        new = np.ones(len(order), dtype=bool)
        new[1:] = (np.diff(doc) != 0) | (np.diff(text) != 0) | (np.diff(diagonal) != 0) | (np.diff(position) != 1)
        runs = np.diff(np.append(np.flatnonzero(new), len(order)))
        np.maximum.at(longest, doc[new], runs - 1 + span[new])
    edges = np.diff(np.concatenate(([0], hit.astype(np.int8), [0])))
    begins, ends = np.flatnonzero(edges == 1), np.flatnonzero(edges == -1)
    spans: dict[int, list] = {}
    totals = np.zeros(len(words), dtype=np.int64)
    for a, b in zip(begins.tolist(), ends.tolist()):
        d = int(np.searchsorted(starts, a, "right")) - 1
        totals[d] += b - a
        spans.setdefault(d, []).append({"start": a - int(starts[d]), "n_words": b - a})
    return [
        (int(counts[d]), int(totals[d]), sorted(items.get(d, ())), spans.get(d, []), int(longest[d])) for d in range(len(words))
    ]


def _blocks(benchmark: DataFrame, item_id: str, text: str, window: int, block_words: int) -> list:
    """Broadcast blocks. Items pass through the driver one block at a time, each block bounded."""
    context = benchmark.sparkSession.sparkContext
    sent, held, size = [], {}, 0
    for row in benchmark.select(F.col(item_id).cast("string").alias("i"), F.col(text).alias("t")).toLocalIterator():
        words = tuple(words_of(row.t.encode()) if row.t else ())
        if not words:
            continue
        held.setdefault(words, []).append("null" if row.i is None else row.i)
        size += len(words)
        if size >= block_words:
            sent.append(context.broadcast(Block(held, window)))
            held, size = {}, 0
    if held:
        sent.append(context.broadcast(Block(held, window)))
    return sent


def _loaded(sent: list) -> Iterator[Block]:
    for block in sent:
        yield block.value
        if len(sent) > 1:  # one block in memory at a time; the file of the broadcast stays
            del block._value


def matches(docs: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text", window: int = WINDOW, block_words: int = BLOCK_WORDS) -> DataFrame:
    """One row per document: doc_id, n_words, n_hit, item_ids (as sorted strings), spans of hit words, longest match in words."""
    sent = _blocks(benchmark, item_id, item_text, window, block_words)
    schema = T.StructType([T.StructField("doc_id", docs.schema[doc_id].dataType), *MATCHES.fields])
    kinds = [pa.int64(), pa.int64(), pa.list_(pa.string()), pa.list_(pa.struct([("start", pa.int32()), ("n_words", pa.int32())])), pa.int32()]

    def run(batches):
        for batch in gathered(batches, SHARD_BYTES):
            rows = match_shard(texts_of(batch.column(1)), _loaded(sent))
            columns = [pa.array(values, kind) for values, kind in zip(zip(*rows), kinds)] if rows else [pa.array([], kind) for kind in kinds]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], names=schema.names)

    return map_batches(docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")), run, schema)


def remove_contaminated(docs: DataFrame, benchmark: DataFrame, text: str = "text", item_id: str = "item_id", item_text: str = "text", window: int = WINDOW, block_words: int = BLOCK_WORDS) -> DataFrame:
    """``docs`` without the rows that hold any window of ``benchmark``; columns as they are, no shuffle."""
    sent = _blocks(benchmark, item_id, item_text, window, block_words)
    at = docs.columns.index(text)

    def run(batches):
        for batch in gathered(batches, SHARD_BYTES):
            clean = [row[1] == 0 for row in match_shard(texts_of(batch.column(at)), _loaded(sent))]
            yield batch.filter(pa.array(clean, pa.bool_()))

    return map_batches(docs, run, docs.schema)
