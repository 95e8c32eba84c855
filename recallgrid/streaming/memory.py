"""Access-frequency memory, in batch and as a stream.

Items (nodes or edges) are made by their first event and live by their accesses.
Defined results: null items and times are left out; equal events count each; an
empty log has no items.
"""

from __future__ import annotations

import heapq
import math
import re
from collections.abc import Iterator
from dataclasses import dataclass
from decimal import ROUND_HALF_UP, Decimal

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import IntegerType, StructField, StructType

from recallgrid.functions.text import summary

#: What separates words in Spark's patterns.
_BLANKS = re.compile(r"[ \t\n\x0b\f\r]+")


@dataclass(frozen=True)
class MemoryParams:
    forget_below: float = 0.1
    compress_below: float = 0.3
    boost: float = 1.5
    max_nodes: int = 10_000
    max_edges: int = 50_000
    protected: float = 0.8
    base_coefficient: float = 0.1
    max_coefficient: float = 0.9


def totals(events: DataFrame, item: str = "user_id", ts: str = "ts") -> DataFrame:
    """(``node``, ``accesses``, ``first_ts``, ``last_ts``); works on batch and streaming frames alike."""
    return events.where(F.col(item).isNotNull() & F.col(ts).isNotNull()).groupBy(F.col(item).alias("node")).agg(F.count("*").alias("accesses"), F.min(ts).alias("first_ts"), F.max(ts).alias("last_ts"))


def frequency(accesses: Column, total: Column, age_s: Column) -> Column:
    """Accesses an hour of age, relative to all accesses, 1 at most; an age of 0 counts as a second; 0 without any access."""
    age = F.when(age_s == 0, 1.0).otherwise(age_s)
    return F.when(total == 0, 0.0).otherwise(F.least(F.lit(1.0), accesses / (total * age / 3600)))


def state(f: Column, p: MemoryParams = MemoryParams()) -> Column:
    """Where pruning puts an active item."""
    return F.when(f < p.forget_below, "forgotten").when(f < p.compress_below, "compressed").otherwise("active")


def memory_states(events: DataFrame, item: str = "user_id", p: MemoryParams = MemoryParams()) -> DataFrame:
    """(``node``, ``accesses``, ``last_ts``, ``frequency``, ``state``) when pruned at the time of the last event."""
    t = totals(events, item)
    every = t.agg(F.sum("accesses").alias("total"), F.max("last_ts").alias("now"))  # one row
    age = (F.unix_micros(F.col("now").cast("timestamp")) - F.unix_micros(F.col("first_ts").cast("timestamp"))) / 1e6
    f = F.round(frequency(F.col("accesses"), F.col("total"), age), 9)
    return t.crossJoin(every).withColumn("frequency", f).select("node", "accesses", "last_ts", "frequency", state(F.col("frequency"), p).alias("state"))


def reactivated(states: DataFrame, later: DataFrame, item: str = "user_id", p: MemoryParams = MemoryParams()) -> DataFrame:
    """(``node``, ``state``, ``weight``) after more events: forgotten nodes that are accessed come back, heavier; new nodes are active."""
    seen = later.where(F.col(item).isNotNull()).select(F.col(item).alias("node")).distinct().withColumn("__seen", F.lit(True))
    back = (F.col("state") == "forgotten") & F.col("__seen").isNotNull()
    return states.select("node", "state").join(seen, "node", "full_outer").select("node", F.when(back, "reactivated").otherwise(F.coalesce("state", F.lit("active"))).alias("state"), F.when(back, p.boost).otherwise(1.0).alias("weight"))


def coefficient(nodes: Column, edges: Column, p: MemoryParams = MemoryParams()) -> Column:
    """How readily a memory of so many nodes and edges forgets."""
    full = F.greatest(nodes / p.max_nodes, edges / p.max_edges)
    return F.least(F.lit(p.max_coefficient), p.base_coefficient + (p.max_coefficient - p.base_coefficient) * full)


def crowded(nodes: Column, edges: Column, p: MemoryParams = MemoryParams()) -> Column:
    """Whether adding must be followed by pruning."""
    return F.greatest(nodes / p.max_nodes, edges / p.max_edges) > p.protected


def memory_stats(nodes: DataFrame, edges: DataFrame, p: MemoryParams = MemoryParams()) -> DataFrame:
    """One row: nodes by state, edges, all accesses, the coefficient and whether it is crowded."""
    n = nodes.agg(F.count("*").alias("nodes"), *(F.count_if(F.col("state") == s).alias(s) for s in ("active", "compressed", "forgotten", "reactivated")), F.coalesce(F.sum("accesses"), F.lit(0)).alias("accesses"))
    both = n.crossJoin(edges.agg(F.count("*").alias("edges")))
    return both.withColumn("coefficient", coefficient(F.col("nodes"), F.col("edges"), p)).withColumn("crowded", crowded(F.col("nodes"), F.col("edges"), p))


def evicted(states: DataFrame, capacity: int) -> DataFrame:
    """The nodes that go when there are more than ``capacity``: forgotten ones, the longest unused first (ties: the smaller node)."""
    over = max(0, states.count() - capacity)
    return states.where("state = 'forgotten'").orderBy("last_ts", "node").limit(over)


def active(states: DataFrame) -> DataFrame:
    return states.where(F.col("state").isin("active", "reactivated"))


def search(nodes: DataFrame, queries: DataFrame, k: int = 10, include_forgotten: bool = False) -> DataFrame:
    """(``query_id``, ``rank``, ``node``, ``score``): nodes (node, content, weight, state, optional ``tag`` and ``similarity_<query>`` left to the
    caller) for queries (query_id, query): the weight, doubled where the content holds the query, else times 1 and the share of its
    words that it holds; half as much again where the tag holds the query.  A stated set of queries against all nodes."""
    usable = nodes if include_forgotten else nodes.where("state <> 'forgotten'")
    q = queries.where("query is not null").select("query_id", F.lower("query").alias("q"))
    asked = q.collect()  # the stated set
    texts = [r["q"] for r in asked]
    words = [list(dict.fromkeys(w for w in _BLANKS.split(x) if w)) for x in texts]
    inner = [len({w for w in _BLANKS.split(x)[1:-1] if w}) for x in texts]  # a text that holds the query has these as words
    holders: dict[str, list[int]] = {}
    for i, own in enumerate(words):
        for w in own:
            holders.setdefault(w, []).append(i)
    shared = nodes.sparkSession.sparkContext.broadcast((texts, {w: np.array(i) for w, i in holders.items()}, np.array([max(len(w), 1) for w in words], float), np.array(inner)))
    tag = F.lower("tag") if "tag" in usable.columns else F.lit(None).cast("string")
    x = usable.select("node", F.col("weight").cast("double").alias("weight"), F.lower(F.coalesce("content", F.lit(""))).alias("c"), tag.alias("t"))

    def run(batches):
        texts, holders, sizes, inner = shared.value
        tags: dict = {}
        kept = [[] for _ in texts]
        for b in batches:
            for at in range(0, b.num_rows if texts else 0, 1_000):
                node, weight, content, tag = (c.to_pylist() for c in b.slice(at, 1_000).columns)
                score = np.empty((len(node), len(texts)))
                for i, (w, c, t) in enumerate(zip(weight, content, tag)):
                    n = np.zeros(len(texts))
                    for word in set(_BLANKS.split(c)) & holders.keys():
                        n[holders[word]] += 1
                    factor = 1.0 + n / sizes
                    for j in np.flatnonzero(n >= inner).tolist():
                        if texts[j] in c:
                            factor[j] = 2.0
                    if t not in tags:
                        tags[t] = np.array([1.5 if t is not None and x in t else 1.0 for x in texts])
                    score[i] = (np.nan if w is None else w) * factor * tags[t]
                score = _half_up(score)
                for j in range(len(texts)):
                    own = score[:, j]
                    bar = kept[j][k - 1][0] if len(kept[j]) >= k else np.inf  # the negative score of the last that is kept
                    some = np.flatnonzero((-own <= bar) | np.isnan(own)).tolist()
                    if some:
                        kept[j] = heapq.nsmallest(k, kept[j] + [(np.inf if math.isnan(own[i]) else -own[i], node[i]) for i in some])
        rows = [(j, node, None if s == np.inf else -s) for j, own in enumerate(kept) for s, node in own]
        yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], kind), pa.array([r[2] for r in rows], pa.float64())], names=["at", "node", "score"])

    kind = to_arrow_type(x.schema["node"].dataType)
    found = x.mapInArrow(run, f"at int, node {x.schema['node'].dataType.simpleString()}, score double")  # k rows a query and task
    names = nodes.sparkSession.createDataFrame([(i, r["query_id"]) for i, r in enumerate(asked)], StructType([StructField("at", IntegerType()), q.schema["query_id"]]))
    each = found.join(F.broadcast(names), "at").select("query_id", "node", "score")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "node"))
    return each.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "node", "score")


def _half_up(x: np.ndarray) -> np.ndarray:
    """Rounded to 6 digits as Spark does: half up by the decimal digits of the number."""
    y = x * 1e6
    out = np.floor(y + 0.5) / 1e6
    with np.errstate(invalid="ignore"):
        close = np.abs(y - np.floor(y) - 0.5) < 1e-6 + np.abs(y) * 1e-15
    for at in zip(*np.nonzero(close)):
        out[at] = float(Decimal(repr(float(x[at]))).quantize(Decimal("1e-6"), ROUND_HALF_UP))
    return out


def with_summary(nodes: DataFrame) -> DataFrame:
    """``nodes`` with ``compressed_content`` where the state is compressed."""
    return nodes.withColumn("compressed_content", F.when(F.col("state") == "compressed", summary(F.col("content"))))


def stream_totals(events: DataFrame, path: str, checkpoint: str, item: str = "user_id", ts: str = "ts"):
    """A streaming query that keeps accesses, first and last time of each item as keyed state, and appends what changed in each batch to
    Parquet (``batch`` numbers them): the state holds a row an item, the driver none."""
    def step(key: tuple, parts: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        n, first, last = state.get if state.exists else (0, None, None)
        for df in parts:
            n += len(df)
            low, high = df["us"].min(), df["us"].max()
            first, last = int(low if first is None else min(first, low)), int(high if last is None else max(last, high))
        state.update((n, first, last))
        yield pd.DataFrame({"node": [key[0]], "accesses": [n], "first_us": [first], "last_us": [last]})

    kind = events.schema[item].dataType.simpleString()
    slim = events.where(F.col(item).isNotNull() & F.col(ts).isNotNull()).select(F.col(item).alias("node"), F.unix_micros(F.col(ts).cast("timestamp")).alias("us"))
    changed = slim.groupBy("node").applyInPandasWithState(step, f"node {kind}, accesses long, first_us long, last_us long", "n long, first long, last long", "update", "NoTimeout")
    put = lambda df, batch: df.withColumn("batch", F.lit(batch)).write.mode("append").parquet(path)
    return changed.writeStream.outputMode("update").foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def stream_latest(stored: DataFrame) -> DataFrame:
    """The last state of each item from what :func:`stream_totals` appended."""
    best = F.max_by(F.struct("accesses", "first_us", "last_us"), "batch").alias("x")
    return stored.groupBy("node").agg(best).select("node", "x.accesses", F.timestamp_micros("x.first_us").alias("first_ts"), F.timestamp_micros("x.last_us").alias("last_ts"))
