"""Mixing sources to target weights by Pfair scheduling.

Every source is cut into blocks of BLOCK_CHARS characters of its documents, in
a fixed pseudo-random order. The j-th block of a source with weight w may be
placed from slot floor((j - 1) / w) on and must be placed by slot ceil(j / w);
of the released blocks the one with the earliest deadline takes the slot. So at
every slot each source has had its weight's share to within less than one
block, however many slots there are: releases and deadlines are whole-number
arithmetic on the exact weights.

Target weights are whole numbers of parts (or fractions). After as many slots
as the reduced parts add up to, each source has had exactly its parts, and the
schedule begins again. One such period, at most a few times PARTS slots, is
laid out once; the slot of any block then follows from its number by division,
in every task on its own, so the schedule's length costs nothing. When a source
runs dry, the weights of the rest are scaled up and a new phase with a period of
its own begins: at most one phase a source, and a row for each source in it.
Each document is placed once; none is dropped or repeated.

Defined results: a null source is a source like others; documents of null or
empty text take one character's room; sources without a given weight get the
mean of the given ones; sources of weight 0 come after all others; equal rows
follow one another in either order; an empty table gives an empty result; other
columns are kept aside or as they are.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator, Mapping
from fractions import Fraction
from math import gcd, lcm

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldline.llm.batches import free_name
from fieldline.llm.ordering import running_total
from fieldline.session import materialise

BLOCK_CHARS = 16_384
PARTS = 10_000
TEMPERATURE = 0.5
SEED = 17
# The longest period that is laid out; weights that need a longer one are refused.
MOST_SLOTS = 5_000_000


def default_weights(sizes: Mapping, parts: int = PARTS) -> dict:
    """Target weights in whole parts of about ``parts``, one at least: characters to the power TEMPERATURE."""
    raw = {s: n**TEMPERATURE for s, n in sizes.items()}
    total = sum(raw.values())
    return {s: max(1, round(parts * w / total)) for s, w in raw.items()}


def whole_parts(weights: Mapping) -> dict:
    """Weights above 0 as the smallest whole numbers in the same proportions; a float counts as the decimal it is written as."""
    exact = {s: Fraction(str(w)) if isinstance(w, float) else Fraction(w) for s, w in weights.items()}
    scale = lcm(*(w.denominator for w in exact.values()))
    whole = {s: int(w * scale) for s, w in exact.items()}
    shared = gcd(*whole.values())
    whole = {s: w // shared for s, w in whole.items()}
    if sum(whole.values()) > MOST_SLOTS:
        raise ValueError(f"a period of these weights has {sum(whole.values())} slots; give whole numbers that add up to {MOST_SLOTS} at most")
    return whole


def schedule(weights: Mapping) -> Iterator:
    """The source of every slot, without end; weights are above 0, ties go to the source listed first."""
    names, total = list(weights), sum(map(Fraction, weights.values()))
    gaps = [(total / Fraction(w)).as_integer_ratio() for w in weights.values()]
    waiting, ready, slot = [(0, k, 0) for k in range(len(names))], [], 0
    while True:
        while waiting and waiting[0][0] <= slot:
            _, k, j = heapq.heappop(waiting)
            heapq.heappush(ready, (-(-(j + 1) * gaps[k][0] // gaps[k][1]), k, j))
        _, k, j = heapq.heappop(ready)  # at full use of the slots one is always ready
        # The next block is never released before the last slot of this one.
        heapq.heappush(waiting, ((j + 1) * gaps[k][0] // gaps[k][1], k, j + 1))
        yield names[k]
        slot += 1


def earliest_deadline_first(parts: Mapping) -> dict:
    """The slots of each source in one period: sum(parts) slots, of which each has its parts."""
    slots = {s: [] for s in parts}
    for slot, s in zip(range(sum(parts.values())), schedule(parts)):
        slots[s].append(slot)
    return slots


def phases(counts: Mapping, weights: Mapping) -> list[tuple]:
    """(source, first block, end block, first slot, period, slots of a period) for every source in every phase.

    ``counts`` are the blocks of each source. Block b of a phase is in slot
    ``first slot + q * period + slots[r]``, q and r being (b - first block)
    divided by the source's parts. A phase ends with the slot that takes the last
    block of some source.
    """
    left, done, start, out = {s: n for s, n in counts.items() if n}, dict.fromkeys(counts, 0), 0, []
    while left:
        parts = whole_parts({s: weights[s] for s in left if weights[s] > 0} or dict.fromkeys(left, 1))
        slots, period = earliest_deadline_first(parts), sum(parts.values())
        last = min((left[s] - 1) // len(own) * period + own[(left[s] - 1) % len(own)] for s, own in slots.items())
        turns, rest = divmod(last + 1, period)
        for s, own in slots.items():
            taken = turns * len(own) + sum(x < rest for x in own)
            if taken:
                out.append((s, done[s], done[s] + taken, start, period, own))
            done[s] += taken
            left[s] -= taken
        start += last + 1
        left = {s: n for s, n in left.items() if n}
    return out


def _layout(spark: SparkSession, counts: Mapping, weights: Mapping) -> DataFrame:
    """``phases`` as rows: a period's slots for every source and phase."""
    schema = "_source string, _first long, _end long, _start long, _period long, _slots array<long>"
    return spark.createDataFrame(phases(counts, weights), schema)


def _key(seed: int, doc_id: str, source: str, text: str):
    return F.xxhash64(F.lit(seed), F.col(doc_id), F.col(source), F.col(text))


def _placed(docs: DataFrame, doc_id: str, source: str, text: str, weights: Mapping | None, block_chars: int, seed: int) -> DataFrame:
    """(doc_id, source, key, chars, block, slot, within) of every row; no text."""
    rows = docs.select(
        F.col(doc_id).alias("doc_id"),
        F.col(source).cast("string").alias("source"),
        _key(seed, doc_id, source, text).alias("key"),
        F.greatest(F.coalesce(F.length(text), F.lit(1)), F.lit(1)).cast("long").alias("chars"),
    )
    placed = materialise(running_total(rows, "chars", ["key", "doc_id"], ["source"]), "mix-blocks")
    # One row per source: as many as there are weights to give.
    sizes = {r.source: r.chars for r in placed.groupBy("source").agg(F.sum("chars").alias("chars")).collect()}
    if weights is None:
        targets = default_weights(sizes)
    else:
        mean = sum(Fraction(str(w)) for w in weights.values()) / len(weights)
        targets = {s: weights.get(s, mean) for s in sizes}
    names = sorted(sizes, key=lambda s: (s is not None, s or ""))
    counts = {s: -(-sizes[s] // block_chars) for s in names}
    # Bounded by the number of sources: a row for each in each phase, MOST_SLOTS numbers a phase.
    layout = F.broadcast(_layout(docs.sparkSession, counts, {s: targets[s] for s in names}))
    blocked = placed.withColumn("block", F.floor(F.col("before") / F.lit(block_chars)).cast("long"))
    own = blocked["source"].eqNullSafe(layout["_source"]) & (F.col("block") >= F.col("_first")) & (F.col("block") < F.col("_end"))
    slot = F.expr("_start + (block - _first) div size(_slots) * _period + get(_slots, int((block - _first) % size(_slots)))")
    return blocked.join(layout, own).select("doc_id", "source", "key", "chars", "block", slot.alias("slot"), (F.col("before") % block_chars).alias("within"))


def order(docs: DataFrame, doc_id: str = "doc_id", source: str = "source", text: str = "text", weights: Mapping | None = None, block_chars: int = BLOCK_CHARS, seed: int = SEED) -> DataFrame:
    """One row per document: doc_id, source, chars, block (of its source), slot, and position in the mixed order (from 0).

    ``weights`` maps sources to target weights, whole numbers or fractions;
    without them ``default_weights`` of their characters hold.
    """
    placed = _placed(docs, doc_id, source, text, weights, block_chars, seed)
    ranked = running_total(placed.withColumn("_one", F.lit(1)), "_one", ["slot", "within", "key", "doc_id"], into="position")
    return ranked.select("doc_id", "source", "key", "chars", "block", "slot", "position")


def mixed(docs: DataFrame, doc_id: str = "doc_id", source: str = "source", text: str = "text", weights: Mapping | None = None, block_chars: int = BLOCK_CHARS, seed: int = SEED) -> DataFrame:
    """``docs`` in the mixed order: partitions and their rows ascend; all rows and columns as they are."""
    placed = _placed(docs, doc_id, source, text, weights, block_chars, seed)
    into = [free_name(docs.columns, c) for c in ("slot", "within", "key")]
    places = placed.groupBy("key").agg(F.min(F.struct("slot", "within")).alias("p")).select(F.col("key").alias(into[2]), F.col("p.slot").alias(into[0]), F.col("p.within").alias(into[1]))
    places = materialise(places, "mix-places")
    keyed = docs.withColumn(into[2], _key(seed, doc_id, source, text))
    # A row for each document: not for the driver, however small its files.
    found = keyed.join(places.hint("shuffle_merge"), into[2])
    return found.repartitionByRange(*into).sortWithinPartitions(*into).select(*docs.columns)


