"""Exact top-k search by inner product, by the three-phase uniform threshold.

A score is a sum over SEGMENTS parts of the components; each part keeps a list
of partial scores for every query, as a node of the published algorithm does.

1. Gather: in every block of candidates each part names its k best partial
   scores for a query; the sums of those candidates are gathered.
2. Cut off: the k-th best gathered sum of a query is a score that at least k
   candidates reach. It goes back to the blocks. A candidate can reach it only
   if some part reaches the cutoff divided by the number of parts, so entries
   above that uniform threshold suffice.
3. Resolve: the remaining parts of those entries are added, and the k best of
   each block that reach the cutoff are merged.

Queries meet candidates in pairs of blocks of a bounded size, so nothing is
broadcast, collected or held that grows with the data; a block gives at most k
rows for a query, however many candidates tie.

Defined results: null vectors and those with null or non-finite components
take no part; vectors of unequal length are compared as if the shorter ended in
zeros; every row is a candidate of its own, so repeated rows may hold several
ranks, and every row chosen by ``queries`` is a query of its own; rows with the
query's id are not its candidates; rows without an id are candidates, last
among equal scores, but no queries; scores beyond a long count as the largest on either side; an
empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fieldline.llm.batches import map_batches
from fieldline.llm.vectors import as_long, blocks, exact_kind, ids_of, largest, unpacked, whole_vectors
from fieldline.session import discard, materialise

K = 20
SCALE = 64
EVERY = 20
SEGMENTS = 4
BLOCK_ROWS = 4096
# Partial scores held at a time, per part.
PAIRS = 1 << 20


def partial_scores(queries: np.ndarray, candidates: np.ndarray, segments: int = SEGMENTS) -> list[np.ndarray]:
    """Exact inner products of each part of the components."""
    width = queries.shape[1]
    kind = exact_kind(max(1, width) * largest(queries) * largest(candidates) * segments)
    left, right = queries.astype(kind), candidates.astype(kind).T
    edges = np.linspace(0, width, segments + 1).astype(int)
    return [left[:, a:b] @ right[a:b] for a, b in zip(edges[:-1], edges[1:])]


def gathered_scores(parts: list[np.ndarray], own: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, score) of the candidates named by the k best of each part: the k best of their sums; ``own`` pairs are left out."""
    rows, many = own.shape
    if many <= k * len(parts):
        named = np.broadcast_to(np.arange(many), (rows, many))
    else:
        # An own pair may be named; the next best is not put in its place, which keeps the sums a lower bound.
        named = np.concatenate([np.argpartition(p, many - k, axis=1)[:, many - k :] for p in parts], axis=1)
        named = np.sort(named, axis=1)
    line = np.arange(rows)[:, None]
    sums = as_long(sum(p[line, named] for p in parts))
    valid = ~own[line, named]
    valid[:, 1:] &= named[:, 1:] != named[:, :-1]
    row, at = np.nonzero(valid)
    score = sums[row, at]
    order = np.lexsort((-score, row))
    row, score = row[order], score[order]
    first = np.searchsorted(row, np.arange(rows))
    best = np.arange(len(row)) - first[row] < k
    return row[best], score[best]


def sufficient_entries(parts: list[np.ndarray], own: np.ndarray, cutoff: np.ndarray, known: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, candidate, score) of the entries that reach the cutoff of their row; all entries of rows without a known cutoff."""
    m = len(parts)
    uniform = -((-cutoff) // m)  # partial scores are whole, so a part reaches cutoff / m if it reaches this
    uniform = uniform.astype(object if parts[0].dtype == object else parts[0].dtype)[:, None]
    reported = np.zeros(own.shape, dtype=bool)
    for p in parts:
        reported |= p >= uniform
    reported[~known] = True
    entries = np.flatnonzero(reported & ~own)
    score = sum(p.reshape(-1)[entries] for p in parts)
    row = entries // max(1, own.shape[1])
    score = as_long(score)
    enough = (score >= cutoff[row]) | ~known[row]
    return row[enough], entries[enough] % max(1, own.shape[1]), score[enough]


_PAIR = ["block", "query_block"]
_GATHERED = T.StructType([T.StructField(n, T.LongType()) for n in ("query_block", "place", "score")])
_RESOLVED = T.StructType([T.StructField(n, T.LongType()) for n in ("query_block", "place", "query_id", "vec_id", "score")])


def _cells(candidates: DataFrame, queries: DataFrame, n_candidates: int, n_queries: int) -> DataFrame:
    """Every block of queries beside every block of candidates; both are dealt by the pair, so that no block is hot."""
    numbers = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long")))
    left = candidates.select("block", "ids", "x", "width", numbers(n_queries).alias("query_block"))
    renamed = {"block": "query_block", "first": "query_first", "ids": "query_ids", "x": "query_x", "width": "query_width"}
    right = queries.withColumnsRenamed(renamed).withColumn("block", numbers(n_candidates))
    return left.join(right.hint("shuffle_merge"), _PAIR)


def _over_cells(cells: DataFrame, width: int, visit, schema: T.StructType) -> DataFrame:
    """``visit`` on bounded parts of each cell; it returns the columns of ``schema``."""

    def run(batches):
        for batch in batches:
            held = {n: batch.column(n) for n in batch.schema.names}
            for i in range(batch.num_rows):
                ids, missing = ids_of(held["ids"], i)
                query_ids, _ = ids_of(held["query_ids"], i)
                x = unpacked(held["x"][i].as_py(), held["width"][i].as_py(), width)
                q = unpacked(held["query_x"][i].as_py(), held["query_width"][i].as_py(), width)
                x, q = (v if width else np.zeros((len(n), 0), np.int64) for v, n in ((x, ids), (q, query_ids)))
                cutoffs = held["cutoffs"][i].values if "cutoffs" in held else None
                step, first = max(1, PAIRS // max(1, len(ids))), held["query_first"][i].as_py()
                for start in range(0, len(query_ids), step):
                    part = slice(start, start + step)
                    own = (query_ids[part, None] == ids) & ~missing
                    own_cutoffs = None if cutoffs is None else cutoffs[start : start + step]
                    found = visit(partial_scores(q[part], x), own, ids, missing, query_ids[part], own_cutoffs, first + start)
                    if len(found[0]):
                        number = np.full(len(found[0]), held["query_block"][i].as_py(), dtype=np.int64)
                        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in (number, *found)], names=schema.names)

    return map_batches(cells, run, schema)


def top_k(
    rows: DataFrame, queries: Column | None = None, k: int = K, vec_id: str = "vec_id", vector: str = "embedding", scale: int = SCALE, block_rows: int = BLOCK_ROWS
) -> DataFrame:
    """query_id, rank (from 1), vec_id and score of each query's ``k`` highest inner products of floor(scale * component).

    ``queries`` is a condition on vec_id; by default ids divisible by EVERY.
    Equal scores are ranked by ascending id.
    """
    stored = materialise(whole_vectors(rows, vector, vec_id, scale), "topk-vectors")
    chosen = F.col("vec_id") % EVERY == 0 if queries is None else queries
    sizes = stored.agg(F.count("*").alias("n"), F.count(F.when(chosen, 1)).alias("q"), F.coalesce(F.max(F.size("x")), F.lit(0)).alias("width")).first()
    width = sizes.width
    parts = lambda n: max(1, -(-n // block_rows))
    # A task that is dealt a few rows too many makes a second, small block of them.
    candidates = materialise(blocks(stored.repartition(parts(sizes.n)), width, block_rows), "topk-candidates")
    asked = materialise(blocks(stored.filter(chosen & F.col("vec_id").isNotNull()).repartition(parts(sizes.q)), width, block_rows), "topk-queries")
    grid = parts(sizes.n), parts(sizes.q)

    def gather(parts, own, ids, missing, query_ids, cutoffs, start):
        row, score = gathered_scores(parts, own, k)
        return row + start, as_long(score)

    lists = _over_cells(_cells(candidates, asked, *grid), width, gather, _GATHERED)
    place = ["query_block", "place"]
    best = Window.partitionBy(*place).orderBy(F.desc("score"))
    kth = lists.withColumn("nth", F.row_number().over(best)).filter(F.col("nth") == k)
    # One cutoff for each query of a block, in their order; null where fewer than k candidates were gathered.
    cutoffs = kth.groupBy("query_block").agg(F.map_from_entries(F.collect_list(F.struct("place", "score"))).alias("_kth"))
    with_cutoffs = asked.join(cutoffs, asked["block"] == cutoffs["query_block"], "left").select(
        *asked.columns, F.transform(F.sequence(F.col("first"), F.col("first") + F.size("ids") - 1), lambda i: F.col("_kth")[i]).alias("cutoffs")
    )
    cut = materialise(with_cutoffs, "topk-cutoffs")

    def resolve(parts, own, ids, missing, query_ids, cutoffs, start):
        known = cutoffs.is_valid().to_numpy(zero_copy_only=False)
        cutoff = cutoffs.fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
        row, at, score = sufficient_entries(parts, own, cutoff, known)
        order = np.lexsort((ids[at], missing[at], -score, row))
        row, at, score = row[order], at[order], score[order]
        first = np.searchsorted(row, np.arange(len(query_ids)))
        best = np.arange(len(row)) - first[row] < k
        row, at, score = row[best], at[best], score[best]
        return row + start, query_ids[row], pa.array(ids[at], pa.int64(), mask=missing[at]), score

    entries = _over_cells(_cells(candidates, cut, *grid), width, resolve, _RESOLVED)
    order = Window.partitionBy(*place).orderBy(F.desc("score"), F.asc_nulls_last("vec_id"))
    ranked = entries.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    out = materialise(ranked.select("query_id", "rank", "vec_id", "score"), "topk-found")
    discard(stored, candidates, asked, cut)
    return out
