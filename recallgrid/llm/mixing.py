"""Mixing sources to target weights by a Pfair schedule.

Each source is cut into blocks of documents.  With a target weight w, its k-th
block (from 0) is released at slot floor(k / w) and due at slot ceil((k + 1) / w);
in every slot the released block with the earliest deadline is taken.  At any
prefix each source is then less than one block away from its share.

Weights are exact fractions.  The schedule of one period gives the slot of every
block in closed form; where a period is longer than the blocks, it is made as far
as the blocks go, 8 bytes for each block of ``block`` documents.  Where a source
runs out, the others go on with the same weights relative to each other: a new
phase.  Every document is scheduled exactly once.

Defined results
---------------
* a null source is a source of its own; a source without a given weight, and all
  if none are given, weighs as its number of documents to the power ``exponent``
  (given weights are relative to those); sources of weight 0 come evenly after all
  others, negative weights are an error;
* text and its length play no role, null or long texts are scheduled like others;
* documents of a source are ordered by a hash of the id and text, then the id;
  fully equal rows are interchangeable and all kept (in one partition);
* columns ``slot``, ``in_block`` or ``phase`` of the input are replaced in the
  schedule, while :func:`mix_documents` returns the input's columns as they are;
* an empty table gives an empty result.
"""

from __future__ import annotations

import heapq
import math
from dataclasses import dataclass, field
from fractions import Fraction

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

BROADCAST_SOURCES = 100_000


@dataclass(frozen=True)
class MixParams:
    weights: dict = field(default_factory=dict)
    exponent: float = 0.5
    block: int = 32
    seed: int = 3
    slots_per_partition: int = 128


def integer_weights(weights: list[float], period: int) -> list[int]:
    """Whole numbers of at least 1 in the given proportions, that sum to the period (or 4 for each source, if more): rounded, so the schedule uses :func:`exact_weights`."""
    n = len(weights)
    period = max(period, 4 * n)
    w = np.asarray(weights, float)
    exact = w / w.sum() * (period - n) + 1
    a = np.floor(exact).astype(int)
    for i in np.argsort(-(exact - a), kind="stable")[: period - int(a.sum())]:
        a[i] += 1
    return a.tolist()


def exact_weights(weights: list[float]) -> list[int]:
    """Whole numbers in exactly the given proportions, without a common factor."""
    exact = [Fraction(w) for w in weights]
    if any(w < 0 for w in exact):
        raise ValueError("weights must not be negative")
    scale = math.lcm(*(w.denominator for w in exact))
    a = [int(w * scale) for w in exact]
    common = math.gcd(*a) or 1
    return [x // common for x in a]


def one_period(a: list[int], left: list[int] | None = None) -> list[np.ndarray]:
    """Slots of each source in one period of sum(a) slots, earliest deadline first; it ends where a source has taken the blocks it has ``left``."""
    length, taken = sum(a), [0] * len(a)
    out: list[list[int]] = [[] for _ in a]
    later = [(0, i) for i in range(len(a))]
    ready: list[tuple[int, int]] = []
    heapq.heapify(later)
    for t in range(length if left is None else min(length, sum(left))):
        while later and later[0][0] <= t:
            _, i = heapq.heappop(later)
            heapq.heappush(ready, (-(-(taken[i] + 1) * length // a[i]), i))
        _, i = heapq.heappop(ready)
        out[i].append(t)
        taken[i] += 1
        if left is not None and taken[i] == left[i]:
            break
        if taken[i] < a[i]:
            heapq.heappush(later, (taken[i] * length // a[i], i))
    return [np.asarray(x, np.int64) for x in out]


def phases(a: list[int], blocks: list[int]) -> list[dict]:
    """The schedule until all blocks are taken: for each phase its first slot, the slots in a period and, for each active source, (its blocks in a period, their slots, blocks taken before)."""
    taken, start, out = [0] * len(a), 0, []
    while True:
        active = [i for i in range(len(a)) if taken[i] < blocks[i]]
        if not active:
            return out
        active = [i for i in active if a[i]] or active
        common = math.gcd(*(a[i] for i in active))
        w = {i: a[i] // common if common else 1 for i in active}
        left = {i: blocks[i] - taken[i] for i in active}
        slots = dict(zip(active, one_period(list(w.values()), list(left.values()))))
        length = sum(map(len, slots.values()))
        if length < sum(w.values()):  # a source runs out within the first period
            w, end = {i: len(slots[i]) for i in active}, length
        else:
            end = min((left[i] - 1) // w[i] * length + int(slots[i][(left[i] - 1) % w[i]]) + 1 for i in active)
        out.append({"start": start, "length": length, "of": {i: (w[i], slots[i], taken[i]) for i in active if w[i]}})
        for i in active:
            taken[i] += end // length * w[i] + int(np.searchsorted(slots[i], end % length))
        start += end


def slots_of(plan: list[dict], source: int, block: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(slot, phase) of the given blocks of one source."""
    mine = [(p, k) for k, p in enumerate(plan) if source in p["of"]]
    at = np.searchsorted([p["of"][source][2] for p, _ in mine], block, "right") - 1
    slot, phase = np.zeros(len(block), np.int64), np.zeros(len(block), np.int32)
    for j, (p, k) in enumerate(mine):
        here = at == j
        w, s, before = p["of"][source]
        b = block[here] - before
        slot[here], phase[here] = p["start"] + b // w * p["length"] + s[b % w], k
    return slot, phase


def _scheduled(docs: DataFrame, params: MixParams, source_col: str, id_col: str, text_col: str) -> DataFrame:
    """``docs`` with ``__slot``, ``__in`` and ``__phase``, exchanged once: by the range of slots that a row falls in if its hash is at its expected rank.

    The number of rows in each source and range, from a pass that moves none of them, gives the rank of a range's first
    row of a source; it travels with the range's rows, and the ranks of the others follow from their order in it."""
    spark, block, per = docs.sparkSession, params.block, params.slots_per_partition
    counts = docs.groupBy(source_col).agg(F.count("*").alias("n")).collect()  # a row a source
    counts = sorted(((r[0], r["n"]) for r in counts), key=lambda r: (r[0] is None, str(r[0])))
    given = {k: float(v) for k, v in params.weights.items()}
    a = exact_weights([given.get(s, n**params.exponent) for s, n in counts]) if counts else []
    blocks = [-(-n // block) for _, n in counts]
    kind = docs.schema[source_col].dataType.simpleString()
    known = spark.createDataFrame([(s, i) for i, (s, _) in enumerate(counts)], f"__s {kind}, __i int")
    known = F.broadcast(known) if len(counts) <= BROADCAST_SOURCES else known  # else Spark joins by a shuffle
    shared = spark.sparkContext.broadcast((phases(a, blocks), [n for _, n in counts]))  # 8 bytes a block
    ranges = max(1, -(-sum(blocks) // per))

    @F.pandas_udf("int")
    def range_of(source: pd.Series, h: pd.Series) -> pd.Series:
        plan, rows = shared.value
        source, at = source.to_numpy(), (h.to_numpy().astype(np.float64) + 2.0**63) / 2.0**64
        out = np.zeros(len(source), np.int32)
        for s in np.unique(source).tolist():
            here = source == s
            rank = np.minimum((at[here] * rows[s]).astype(np.int64), rows[s] - 1)
            out[here] = slots_of(plan, s, rank // block)[0] // per
        return pd.Series(out)

    @F.pandas_udf("slot long, at int, phase int")
    def place(source: pd.Series, rank: pd.Series) -> pd.DataFrame:
        plan, _ = shared.value
        source, rank = source.to_numpy(), rank.to_numpy()
        slot, phase = np.zeros(len(rank), np.int64), np.zeros(len(rank), np.int32)
        for s in np.unique(source).tolist():
            here = source == s
            slot[here], phase[here] = slots_of(plan, s, rank[here] // block)
        return pd.DataFrame({"slot": slot, "at": (rank % block).astype(np.int32), "phase": phase})

    text = F.lit(0) if text_col not in docs.columns else F.xxhash64(text_col) if docs.schema[text_col].dataType.simpleString() == "string" else F.col(text_col)
    hashed = docs.join(known, F.col(source_col).eqNullSafe(F.col("__s"))).drop("__s").withColumn("__h", F.xxhash64(F.lit(params.seed), F.col(id_col), text))
    keyed = hashed.withColumn("__range", range_of("__i", "__h"))
    sizes = keyed.groupBy("__i", "__range").agg(F.count("*").alias("n"))
    before = F.sum("n").over(Window.partitionBy("__i").orderBy("__range").rowsBetween(Window.unboundedPreceding, -1))
    heads = sizes.select("__i", "__range", F.coalesce(before, F.lit(0)).alias("__first"))
    both = keyed.withColumn("__first", F.lit(None).cast("long")).unionByName(heads, allowMissingColumns=True)
    order = Window.partitionBy("__range", "__i").orderBy(F.col("__first").isNull(), "__h", id_col)
    # the head comes first, so the others are numbered from 1
    ranked = both.repartitionById(ranges, F.col("__range")).withColumn("__n", F.row_number().over(order) - 2 + F.max("__first").over(order)).where(F.col("__first").isNull())
    out = ranked.withColumn("__p", place("__i", "__n"))
    return out.select(*docs.columns, F.col("__p.slot").alias("__slot"), F.col("__p.at").alias("__in"), F.col("__p.phase").alias("__phase"))


def schedule(docs: DataFrame, params: MixParams = MixParams(), source_col: str = "source", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, source, ``slot``, ``in_block``, ``phase``) of every document; in order of (slot, in_block) the sources are mixed."""
    slim = docs.select(id_col, source_col, F.xxhash64(text_col).alias("__text") if text_col in docs.columns else F.lit(0).alias("__text"))
    df = _scheduled(slim, params, source_col, id_col, "__text")
    return df.select(id_col, source_col, F.col("__slot").alias("slot"), F.col("__in").alias("in_block"), F.col("__phase").alias("phase"))


def mix_documents(docs: DataFrame, params: MixParams = MixParams(), source_col: str = "source", id_col: str = "doc_id", text_col: str = "text", order_col: str | None = None, phase_col: str | None = None) -> DataFrame:
    """The rows of ``docs``, all columns: a partition holds the rows around one range of slots, in order (next to the border
    of two ranges a few rows lie on either side of it, as ranges are cut by the expected rank).

    Files don't keep that order; ``order_col`` names a column for it (distinct longs, ascending in the order of the
    schedule), ``phase_col`` one for the phase (0 as long as the target weights hold).
    """
    df = _scheduled(docs, params, source_col, id_col, text_col)
    more = {order_col: F.col("__slot") * params.block + F.col("__in"), phase_col: F.col("__phase")}
    more = {name: c for name, c in more.items() if name}
    return df.sortWithinPartitions("__slot", "__in").select(*(c for c in docs.columns if c not in more), *(c.alias(name) for name, c in more.items()))
