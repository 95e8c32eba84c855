"""Uniform shuffle into shards of exact sizes by a hypergeometric communication matrix.

How many rows of each input chunk go to each shard is drawn exactly (a row of a
matrix with the chunk sizes and shard sizes as margins).  Each chunk permutes its
rows locally and cuts them by its counts, the rows are exchanged once, and each
shard permutes what arrived.  Every permutation of the rows is equally likely.

The matrix is never built.  A chunk range is halved again and again, and the
shard counts of the left half are drawn from those of the whole; a worker draws
the few halvings above its own chunk, each seeded by its range, so that all
workers (and a task that runs again) agree without exchanging anything.  Rows are
known by file and row number in it, so a lost executor changes nothing.

Defined results
---------------
* every row, with nulls, empty or long texts and repeated rows alike, goes to
  exactly one shard; rows are told apart by place, not by content;
* shard sizes are n // shards or one more; more shards than rows leave some empty;
* ``shard`` and ``position`` of the input are replaced by those drawn here;
* an empty table gives an empty result; equal seeds and files give equal shards.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from recallgrid.llm._common import written

CHUNK_BITS = 16
#: Numpy draws from fewer rows than that.
NUMPY_ROWS = 1_000_000_000


@dataclass(frozen=True)
class ShardParams:
    rows_per_shard: int = 8192
    seed: int = 17


def hypergeometric(rng: np.random.Generator, good: int, bad: int, sample: int) -> int:
    """One exact draw; beyond numpy's range by ratio of uniforms over log-factorials."""
    if good + bad < NUMPY_ROWS:
        return int(rng.hypergeometric(good, bad, sample)) if sample else 0
    total = good + bad
    m, k = min(sample, total - sample), min(good, bad)
    p = k / total
    mean, var = m * p, m * p * (1 - p) * (total - m) / max(1, total - 1)
    half = math.sqrt(var + 0.5)
    mode = int((m + 1) * (k + 1) / (total + 2))
    lg = lambda x: math.lgamma(x + 1)
    f = lambda x: lg(x) + lg(k - x) + lg(m - x) + lg(total - k - m + x)
    top, width = f(mode), 1.7155277699214135 * half + 0.8989161620588988
    while True:
        u = rng.random()
        x = math.floor(mean + 0.5 + width * (rng.random() - 0.5) / max(u, 1e-300))
        if max(0, m + k - total) <= x <= min(m, k) and 2 * math.log(max(u, 1e-300)) <= top - f(x):
            break
    if k != good:
        x = m - x
    return x if m == sample else good - x


def split_counts(rng: np.random.Generator, capacity: np.ndarray, sample: int) -> np.ndarray:
    """How many of ``sample`` rows, drawn without replacement, fall to each shard."""
    total = int(capacity.sum())
    if total < NUMPY_ROWS:
        return rng.multivariate_hypergeometric(capacity, sample, method="marginals")
    out = np.zeros_like(capacity)
    for i, c in enumerate(capacity.tolist()):
        total -= c
        out[i] = hypergeometric(rng, c, total, sample)
        sample -= int(out[i])
    return out


def shard_sizes(n: int, shards: int) -> np.ndarray:
    return np.full(shards, n // shards, np.int64) + (np.arange(shards) < n % shards)


def matrix_row(chunk: int, before: np.ndarray, sizes: np.ndarray, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """Counts of one chunk for each shard, and how many rows of earlier chunks each shard gets.

    ``before``: rows in earlier chunks, with the total at the end."""
    lo, hi, here, offset = 0, len(before) - 1, sizes.copy(), np.zeros_like(sizes)
    while hi - lo > 1:
        mid = (lo + hi) // 2
        left = split_counts(np.random.default_rng([seed, lo, hi]), here, int(before[mid] - before[lo]))
        if chunk < mid:
            hi, here = mid, left
        else:
            lo, here, offset = mid, here - left, offset + left
    return here, offset


def shard_documents(docs: DataFrame, params: ShardParams = ShardParams()) -> DataFrame:
    """All rows and columns with ``shard`` and ``position`` (from 0 in each shard), a partition a shard, in order."""
    spark, seed = docs.sparkSession, params.seed
    keep = [c for c in docs.columns if c not in ("shard", "position")]
    try:
        placed = docs.select(*keep, F.xxhash64("_metadata.file_path").alias("__file"), F.col("_metadata.row_index").alias("__row"))
    except AnalysisException:  # not a plain scan: give the rows a place by writing them
        at = F.monotonically_increasing_id()
        placed = written(docs.select(*keep, at.alias("__at")), "rows").select(*keep, F.shiftright("__at", 33).alias("__file"), F.col("__at").bitwiseAND((1 << 33) - 1).alias("__row"))
    placed = placed.withColumn("__chunk", F.shiftright("__row", CHUNK_BITS))
    chunks = placed.groupBy("__file", "__chunk").agg(F.count("*").alias("n")).orderBy("__file", "__chunk").toPandas()  # a row for 65,536 documents
    before = np.concatenate([[0], np.cumsum(chunks["n"].to_numpy(np.int64))]).astype(np.int64)
    n = int(before[-1])
    shards = max(1, -(-n // params.rows_per_shard))
    sizes = shard_sizes(n, shards)
    number = {k: i for i, k in enumerate(zip(chunks["__file"].tolist(), chunks["__chunk"].tolist()))}
    shared = spark.sparkContext.broadcast((number, before, sizes))

    @F.pandas_udf("shard int, arrival long")
    def send(parts: Iterator[tuple[pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        number, before, sizes = shared.value
        drawn: dict = {}  # the chunk that is read now, and the one before

        def of(i: int):
            if i not in drawn:
                if len(drawn) > 1:
                    del drawn[next(iter(drawn))]
                counts, offset = matrix_row(i, before, sizes, seed)
                drawn[i] = counts, offset, np.cumsum(counts), np.random.default_rng([seed, 1 << 40, i]).permutation(int(before[i + 1] - before[i]))
            return drawn[i]

        for file, chunk, row in parts:
            file, chunk, row = file.to_numpy(), chunk.to_numpy(), row.to_numpy()
            shard, arrival = np.zeros(len(row), np.int32), np.zeros(len(row), np.int64)
            for f, c in sorted(set(zip(file.tolist(), chunk.tolist()))):
                counts, offset, ends, place = of(number[f, c])
                here = np.flatnonzero((file == f) & (chunk == c))
                rank = place[row[here] - (c << CHUNK_BITS)]
                s = np.searchsorted(ends, rank, "right")
                shard[here], arrival[here] = s, offset[s] + rank - (ends - counts)[s]
            yield pd.DataFrame({"shard": shard, "arrival": arrival})

    @F.pandas_udf("long")
    def permute(shard: pd.Series, arrival: pd.Series) -> pd.Series:
        sizes = shared.value[2]
        shard, arrival = shard.to_numpy(), arrival.to_numpy()
        out = np.zeros(len(shard), np.int64)
        for s in np.unique(shard).tolist():
            here = shard == s
            out[here] = np.random.default_rng([seed, 1 << 41, s]).permutation(int(sizes[s]))[arrival[here]]
        return pd.Series(out)

    sent = placed.withColumn("__to", send("__file", "__chunk", "__row")).select(*keep, F.col("__to.shard").alias("shard"), F.col("__to.arrival").alias("__arrival"))
    there = sent.repartitionById(shards, "shard")
    return there.withColumn("position", permute("shard", "__arrival")).drop("__arrival").sortWithinPartitions("shard", "position")
