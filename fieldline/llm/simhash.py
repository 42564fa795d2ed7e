"""SimHash near-duplicates by deletion-variant signatures.

Two fingerprints of 64 bits that differ in at most two bits are cut into two
segments of 32 bits; by the pigeonhole principle one segment then differs in at
most one bit. Each segment is indexed whole and with every single bit taken
out (one wildcard), an equality join on these signatures proposes pairs, and
the full distance verifies them. Links become components of linked fingerprints.

Defined results: null and wordless texts have fingerprint 0 and are linked like
any other; repeated rows and equal texts share a fingerprint, hence a
component; null ids are ignored when the smallest id of a component is taken
(a component of null ids only has a null id); an empty table gives an empty
result; other columns of the input are kept aside and never read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fieldline.llm.batches import free_name, map_batches, texts_of
from fieldline.llm.components import components
from fieldline.session import discard, materialise

SHINGLE_WORDS = 3
MAX_BITS = 2
# A signature shared by more fingerprints than this is resolved without pairs.
PAIRED = 16

_BITS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little")


def fingerprint(text: bytes | None, shingle: int = SHINGLE_WORDS) -> int:
    """The unsigned 64-bit fingerprint of one text.

    Lower-cases A-Z, splits at space and U+0009 to U+000D, hashes each shingle
    of space-joined words (XXH64, seed 42) and sets the bits that are set in
    over half of the hashes.
    """
    words = text.lower().split() if text else []
    if not words:
        return 0
    joined = memoryview(b" ".join(words))
    digest = xxhash.xxh64_intdigest
    if len(words) <= shingle:
        hashes = [digest(joined, 42)]
    else:
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        ends = np.cumsum(lengths + 1) - 1
        starts = ends - lengths
        last = len(words) - shingle + 1
        hashes = [digest(joined[a:b], 42) for a, b in zip(starts[:last].tolist(), ends[shingle - 1 :].tolist())]
    return _majority(np.array(hashes, dtype="<u8"))


def _majority(hashes: np.ndarray) -> int:
    """Bits set in over half: counted through a histogram of each of the eight bytes."""
    if len(hashes) >= 512:
        columns = hashes.view(np.uint8).reshape(-1, 8)
        counts = np.concatenate([np.bincount(columns[:, k], minlength=256) @ _BITS for k in range(8)])
    else:
        counts = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(counts * 2 > len(hashes), bitorder="little").tobytes(), "little")


def with_fingerprint(docs: DataFrame, text: str = "text", into: str = "fingerprint", shingle: int = SHINGLE_WORDS) -> DataFrame:
    """``docs`` with a signed 64-bit fingerprint in a further column ``into`` (underscores in front where it is taken)."""
    into = free_name(docs.columns, into)
    schema = T.StructType([*docs.schema.fields, T.StructField(into, T.LongType())])
    at = docs.columns.index(text)

    def run(batches):
        for batch in batches:
            values = np.array([fingerprint(x, shingle) for x in texts_of(batch.column(at))], dtype=np.uint64)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(values.view(np.int64), pa.int64())], names=[*batch.schema.names, into]
            )

    return map_batches(docs, run, schema)


def _signatures(prints: DataFrame) -> DataFrame:
    """(fp, sig): sig holds segment, wildcard and the rest of the segment; wildcard 32 takes no bit out."""
    variants = []
    for segment in range(2):
        half = F.shiftrightunsigned("fp", 32 * segment).bitwiseAND(F.lit(0xFFFFFFFF))
        for wildcard in range(33):
            rest = half.bitwiseAND(F.lit(0xFFFFFFFF & ~(1 << wildcard))) if wildcard < 32 else half
            variants.append(rest.bitwiseOR(F.lit((33 * segment + wildcard) << 32)))
    return prints.select("fp", F.explode(F.array(*variants)).alias("sig"))


def links(prints: DataFrame, max_bits: int = MAX_BITS, paired: int = PAIRED) -> DataFrame:
    """Edges (a, b) that connect exactly the fingerprints linked at ``max_bits`` or fewer bits.

    ``prints`` has distinct fingerprints in column fp. Signatures held by up to
    ``paired`` fingerprints give verified pairs. A signature held by more (a
    large group of near copies) would give the square of the group: its
    members are resolved by whole-fingerprint variants instead. Two
    fingerprints within two bits share a value that differs from both in one
    bit at most, and all that share one are within two bits of each other, so
    one edge to the smallest holder of each shared value says the same. No
    member is left out on either way.
    """
    if max_bits != 2:
        raise ValueError("two segments with one wildcard serve a distance of 2")
    # All joins of tables that grow with the corpus are by shuffle: Spark takes the exploded rows for as many as there are
    # prints, and stored ones for as large as their compressed files, and would send them through the driver.
    signatures = _signatures(prints).hint("shuffle_merge")
    shared = signatures.groupBy("sig").agg(F.count("*").alias("holders")).filter("holders > 1")
    held = materialise(signatures.join(shared, "sig"), "simhash-shared")
    few = held.filter(F.col("holders") <= paired).select("sig", "fp").hint("shuffle_merge")
    distance = F.bit_count(F.col("l.fp").bitwiseXOR(F.col("r.fp")))
    pairs = (
        few.alias("l")
        .join(few.alias("r"), (F.col("l.sig") == F.col("r.sig")) & (F.col("l.fp") < F.col("r.fp")) & (distance <= max_bits))
        .select(F.col("l.fp").alias("a"), F.col("r.fp").alias("b"))
    )
    many = held.filter(F.col("holders") > paired).select("fp").distinct()
    variants = many.select(
        "fp", F.explode(F.array(F.col("fp"), *[F.col("fp").bitwiseXOR(F.lit(_signed(1 << i))) for i in range(64)])).alias("near")
    )
    # A value has at most 65 holders, whatever the data.
    stars = variants.groupBy("near").agg(F.min("fp").alias("a"), F.collect_list("fp").alias("all")).filter(F.size("all") > 1)
    starred = stars.select("a", F.explode("all").alias("b")).filter("a < b")
    edges = materialise(pairs.unionByName(starred).distinct(), "simhash-links")
    discard(held)
    return edges


def _signed(x: int) -> int:
    return x - (1 << 64) if x >= 1 << 63 else x


def groups(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", shingle: int = SHINGLE_WORDS, max_bits: int = MAX_BITS) -> tuple[DataFrame, DataFrame]:
    """Two stored tables: (doc_id, fp) of each row; (fp, root, component_id) of each distinct fingerprint.

    root is the least fingerprint of the component, component_id its smallest doc_id.
    """
    narrow = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    rows = materialise(with_fingerprint(narrow, "text", "fp", shingle).select("doc_id", "fp"), "simhash-rows")
    prints = materialise(rows.groupBy("fp").agg(F.min("doc_id").alias("least")), "simhash-prints")
    edges = links(prints.select("fp"), max_bits)
    roots = components(edges)
    # Fingerprints without a link are components of their own and skip the grouping.
    linked = prints.join(roots.hint("shuffle_merge"), prints["fp"] == roots["node"])
    smallest = linked.groupBy("root").agg(F.min("least").alias("component_id"))
    members = linked.select("fp", "root").join(smallest, "root").select("fp", "root", "component_id")
    alone = prints.join(roots.hint("shuffle_merge"), prints["fp"] == roots["node"], "left_anti")
    alone = alone.select("fp", F.col("fp").alias("root"), F.col("least").alias("component_id"))
    found = materialise(members.unionByName(alone), "simhash-components")
    discard(prints, edges, roots)
    return rows, found


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", shingle: int = SHINGLE_WORDS, max_bits: int = MAX_BITS) -> DataFrame:
    """One row per input row: doc_id, fingerprint (16 hex digits), component_id."""
    rows, found = groups(docs, doc_id, text, shingle, max_bits)
    return rows.join(found.hint("shuffle_merge"), "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", shingle: int = SHINGLE_WORDS, max_bits: int = MAX_BITS) -> DataFrame:
    """``docs`` with one row of each component, the one with the smallest doc_id (null ids last).

    Where several rows have that id, the one with the smallest fingerprint
    stays, and one of rows that repeat both. All columns are kept as they are.
    """
    rows, found = groups(docs, doc_id, text, shingle, max_bits)
    chosen = (
        rows.groupBy("doc_id", "fp").agg(F.count("*").alias("copies"))
        .join(found.hint("shuffle_merge"), "fp")
        .groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "fp", "copies")).alias("pick"))
        .select(F.col("pick.doc_id").alias("_keep_id"), F.col("pick.fp").alias("_keep_fp"), F.col("pick.copies").alias("_copies"))
    )
    chosen = materialise(chosen, "simhash-kept")
    discard(rows, found)
    into = free_name(docs.columns, "fp")
    marked = with_fingerprint(docs, text, into, shingle)
    kept = marked.join(chosen.hint("shuffle_merge"), (marked[into] == chosen["_keep_fp"]) & marked[doc_id].eqNullSafe(chosen["_keep_id"]), "left_semi")
    if chosen.filter("_copies > 1").limit(1).count():
        kept = kept.dropDuplicates([doc_id, into])
    return kept.drop(into)
