"""Token ids of every document as Parquet list columns.

Documents are range-partitioned and sorted by id (or, for documents that are
stored in a wanted order already, taken as they lie), encoded in Arrow batches
and written by Spark's Parquet writer: the ids as a dictionary-encoded list column,
the sorted or small number columns delta-encoded (Parquet format 2), row groups
and pages of controlled size, so that page indexes let a reader fetch the ids of
few documents, or metadata without ids. The ids are below 2**31.

Defined results: null and empty texts have the end id alone; documents with
equal ids are ordered by a hash of their text, then by text; null ids come
first; an empty table writes files without rows; other columns are not written.
"""

from __future__ import annotations

import os
import re
import zlib
from array import array

import numpy as np
import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fieldline.llm.batches import list_array, map_batches, texts_of
from fieldline.session import materialise

END_ID = 2
ROW_GROUP_BYTES = 64 << 20
PAGE_BYTES = 256 << 10
PAGE_ROWS = 1_000
# Limits of one of the two generations of words that a worker remembers.
CACHE_WORDS = 400_000
CACHE_BYTES = 32 << 20

_LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))
# Lower-case letters of Latin-1 with ASCII punctuation behind them (no apostrophe, which some words are cut at), and the characters that byte-level models write for the bytes 128 to 255.
_LATIN = re.compile(r"([a-zß-öø-ÿ]*)([!-&(-/:-@\[-`{-~]*)")
_PRINTED = [*range(161, 173), *range(174, 256)]
_BYTE_LETTERS = {b: chr(b if b in _PRINTED else 289 + [x for x in range(127, 256) if x not in _PRINTED].index(b)) for b in range(128, 256)}
_ENCODERS: dict[str, Encoder] = {}


class Encoder(dict):
    """Encodes texts word by word and remembers the ids of each word, as bytes.

    When too many words are held they become the old generation, from which a
    word comes back when it is met again; the generation before it goes.

    For tokenizers that drop white space and lower-case: neither a merge nor a
    normalisation reaches across ASCII white space, so the ids of a text are
    those of its words in turn, and A-Z may be lower-cased beforehand. A word of
    Latin-1 letters is in normal form and is not split further, and punctuation
    behind it is a piece of its own: the letters go to the merge model directly,
    the punctuation is encoded once. A text that holds the literal of an added
    token, which is one id wherever it stands, goes through the library whole,
    before A-Z are lower-cased; a word that becomes one by that is plain text.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.whole, self.tokenizer = Tokenizer.from_file(path), Tokenizer.from_file(path)
        self.literals = [t.content.encode() for t in self.whole.get_added_tokens_decoder().values()]
        self.tokenizer.encode_special_tokens = True
        self.merge = self.tokenizer.model.tokenize
        self.tails: dict[str, list[int]] = {"": []}
        self.bytes = 0
        self.old: dict[bytes, bytes] = {}

    def __missing__(self, word: bytes) -> bytes:
        self.bytes += len(word)
        if packed := self.old.get(word):
            self[word] = packed
            return packed
        text = word.decode()
        if parts := _LATIN.fullmatch(text):
            stem, tail = parts.groups()
            if not stem.isascii():
                stem = stem.encode().decode("latin-1").translate(_BYTE_LETTERS)
            ids = [t.id for t in self.merge(stem)] if stem else []
            if tail:
                if tail not in self.tails:
                    if len(self.tails) > CACHE_WORDS:
                        self.tails = {"": []}
                    self.tails[tail] = self.tokenizer.encode(tail, add_special_tokens=False).ids
                ids += self.tails[tail]
        else:
            ids = self.tokenizer.encode(text, add_special_tokens=False).ids
        self[word] = packed = array("i", ids).tobytes()
        return packed

    def _packed(self, text: bytes) -> bytes:
        if any(x in text for x in self.literals):
            return array("i", self.whole.encode(text.decode(), add_special_tokens=False).ids).tobytes()
        return b"".join(map(self.__getitem__, text.translate(_LOWER).split()))

    def encode(self, texts: list[bytes | None], end_id: int | None = END_ID) -> tuple[np.ndarray, np.ndarray]:
        """All ids in one array, and the number of ids of each text."""
        if len(self) > CACHE_WORDS or self.bytes > CACHE_BYTES:
            self.old = dict(self)
            self.clear()
            self.bytes = 0
        end = b"" if end_id is None else array("i", [end_id]).tobytes()
        found = [self._packed(t) + end if t else end for t in texts]
        lengths = np.fromiter(map(len, found), np.int64, len(found)) // 4
        return np.frombuffer(b"".join(found), dtype=np.int32), lengths


def encoder(path: str) -> Encoder:
    """One per worker and tokenizer file."""
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


def _by_id(docs: DataFrame) -> DataFrame:
    """Rows (part, doc_id, text) ranged and sorted by id; the part is the number of the range."""
    keys = ["doc_id", F.xxhash64("text")]
    ordered = docs.repartitionByRange(*keys).sortWithinPartitions(*keys, "text")
    return ordered.select(F.lpad(F.spark_partition_id().cast("string"), 10, "0").alias("part"), "doc_id", "text")


def stored_order() -> Column:
    """Where a stored piece of a table stands in the order in which Spark wrote its files: number of the file, place of the piece in it.

    Rows of a piece are read in their order, by one task.
    """
    name, start = F.col("_metadata.file_name"), F.col("_metadata.file_block_start")
    number = F.coalesce(F.nullif(F.regexp_extract(name, r"^part-([0-9]+)", 1), F.lit("")), F.lit("0"))
    return F.concat_ws("/", F.lpad(number, 10, "0"), name, F.lpad(start.cast("string"), 20, "0"))


def _as_stored(docs: DataFrame, columns: list[Column]) -> DataFrame:
    try:
        return docs.select(stored_order().alias("part"), *columns)
    except AnalysisException:  # no files below
        return materialise(docs, "token-texts").select(stored_order().alias("part"), *columns)


def write(docs: DataFrame, path: str, tokenizer: str, doc_id: str = "doc_id", text: str = "text", end_id: int = END_ID, as_stored: bool = False) -> None:
    """Encode every text and write one row per document to ``path``, in ascending order of id.

    With ``as_stored`` the order is that of the files that ``docs`` is read from
    (see ``stored_order``): texts are encoded where they lie and not shuffled.
    Rows that do not come from files are stored first; rows that were dealt out
    anew after reading fail in ``read``.

    Columns: doc_id, part (ascends with the order), offset (ids before this
    document in its part), n_tokens, tokens.
    """
    schema = T.StructType(
        [
            T.StructField("doc_id", docs.schema[doc_id].dataType),
            T.StructField("part", T.StringType()),
            T.StructField("offset", T.LongType()),
            T.StructField("n_tokens", T.LongType()),
            T.StructField("tokens", T.ArrayType(T.IntegerType(), False)),
        ]
    )

    def run(batches):
        encode = encoder(tokenizer).encode
        before: dict[str, int] = {}
        for batch in batches:
            ids, lengths = encode(texts_of(batch.column(2)), end_id)
            offsets = np.cumsum(lengths) - lengths
            # A task may read several parts, one after another.
            parts = batch.column(0).dictionary_encode()
            codes = parts.indices.to_numpy(zero_copy_only=False)
            for code in range(len(parts.dictionary)):
                own, name = codes == code, parts.dictionary[code].as_py()
                offsets[own] = np.cumsum(lengths[own]) - lengths[own] + before.get(name, 0)
                before[name] = before.get(name, 0) + int(lengths[own].sum())
            yield pa.RecordBatch.from_arrays(
                [batch.column(1), batch.column(0), pa.array(offsets), pa.array(lengths), list_array(ids, lengths, pa.int32())], names=schema.names
            )

    own = [F.col(doc_id).alias("doc_id"), F.col(text).alias("text")]
    parted = _as_stored(docs, own) if as_stored else _by_id(docs.select(*own))
    (
        map_batches(parted, run, schema)
        .write.option("parquet.writer.version", "PARQUET_2_0")
        .option("parquet.enable.dictionary", "false")
        .option("parquet.enable.dictionary#tokens.list.element", "true")
        .option("parquet.enable.dictionary#part", "true")
        .option("parquet.block.size", str(ROW_GROUP_BYTES))
        .option("parquet.page.size", str(PAGE_BYTES))
        .option("parquet.page.row.count.limit", str(PAGE_ROWS))
        .option("compression", "zstd")
        .parquet(path)
    )


def read(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start (ids of all documents before it), n_tokens, tokens.

    There is a part for each range or piece of a file, of some megabytes at
    least, so their totals are few (under 100 bytes for each) and are broadcast;
    only the columns n_tokens and part are read for them.
    """
    rows = spark.read.parquet(path)
    whole = F.max(F.col("offset") + F.col("n_tokens")) == F.sum("n_tokens")
    shuffled = F.raise_error(F.lit("documents written as_stored were dealt out anew after they had been read")).cast("long")
    totals = rows.groupBy("part").agg(F.when(whole, F.sum("n_tokens")).otherwise(shuffled).alias("_sum"))
    window = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    bases = totals.select("part", F.coalesce(F.sum("_sum").over(window), F.lit(0)).alias("_base"))
    return rows.join(F.broadcast(bases), "part").select("doc_id", (F.col("offset") + F.col("_base")).alias("start"), "n_tokens", "tokens")


def checksums(tokens: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 (ids as little-endian unsigned 32-bit integers), from the lists read back."""
    schema = T.StructType(
        [
            tokens.schema["doc_id"],
            T.StructField("start", T.LongType()),
            T.StructField("n_tokens", T.LongType()),
            T.StructField("ids_crc32", T.LongType()),
        ]
    )

    def run(batches):
        for batch in batches:
            lists = batch.column(2)
            bounds = lists.offsets.to_numpy().astype(np.int64) * 4
            raw = memoryview(lists.values.to_numpy(zero_copy_only=False).astype("<u4").tobytes())
            sums = [zlib.crc32(raw[a:b]) for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist())]
            counts = pa.array(np.diff(bounds) // 4)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), counts, pa.array(sums, pa.int64())], names=schema.names)

    return map_batches(tokens.select("doc_id", "start", "tokens"), run, schema)
