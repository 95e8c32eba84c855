"""Retrieval and answer metrics.

Defined results: queries without gold have recall 0, answers without gold or
prediction score 0; repeated gold items count once; null predictions count as empty;
an empty table has no rows.
"""

from __future__ import annotations

from collections import Counter

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from recallgrid.functions.text import normalised_answer


def recall_at(k: int, found: Column, gold: Column) -> Column:
    """Share of the distinct gold items among the first k; 0 without gold."""
    g = F.array_distinct(gold)
    return F.when(F.size(g) == 0, 0.0).otherwise(F.size(F.array_intersect(F.slice(found, 1, k), g)) / F.size(g))


def recalls(ranking: DataFrame, gold: DataFrame, ks: tuple[int, ...] = (1, 5, 10, 20)) -> DataFrame:
    """(query_id, ``k``, ``recall``) from rankings (query_id, id, rank) and gold (query_id, id): hits are joined, no list is built."""
    want = gold.where("id is not null").distinct()
    queries = ranking.select("query_id").union(gold.select("query_id")).distinct()
    n = want.groupBy("query_id").agg(F.count("*").alias("n"))
    hits = ranking.where(F.col("rank") <= max(ks)).join(want, ["query_id", "id"]).groupBy("query_id", "id").agg(F.min("rank").alias("rank"))
    hits = hits.groupBy("query_id").agg(*(F.count_if(F.col("rank") <= k).alias(f"h{k}") for k in ks))
    both = queries.join(n, "query_id", "left").join(hits, "query_id", "left")
    share = [F.struct(F.lit(k).alias("k"), F.when(F.col("n") > 0, F.coalesce(f"h{k}", F.lit(0)) / F.col("n")).otherwise(0.0).alias("recall")) for k in ks]
    return both.select("query_id", F.inline(F.array(*share)))


def mean_recalls(per_query: DataFrame) -> DataFrame:
    """(``k``, ``recall``) over all queries, rounded to 4."""
    return per_query.groupBy("k").agg(F.round(F.avg("recall"), 4).alias("recall"))


def exact_match(predicted: Column, gold: Column) -> Column:
    return F.coalesce((normalised_answer(predicted) == normalised_answer(gold)).cast("double"), F.lit(0.0))


def answer_scores(answers: DataFrame, *keys: str) -> DataFrame:
    """(keys, ``em``, ``f1``): the best over the gold answers of a query, from rows (keys, predicted, gold), one a gold answer.

    F1 is that of the multisets of normalised words, 0 without a common one; each row is scored by itself in time linear in
    its words, so no text is exchanged or is a key."""
    p, g = (normalised_answer(F.coalesce(c, F.lit(""))) for c in ("predicted", "gold"))
    each = answers.select(*keys, p.alias("__p"), g.alias("__g"), F.col("gold").isNotNull().alias("__some"))
    scored = each.select(*keys, _answer_scores("__p", "__g", "__some").alias("__x"))
    return scored.groupBy(*keys).agg(F.max("__x.em").alias("em"), F.max("__x.f1").alias("f1"))


@F.pandas_udf(StructType([StructField("em", DoubleType()), StructField("f1", DoubleType())]))
def _answer_scores(predicted: pd.Series, gold: pd.Series, some: pd.Series) -> pd.DataFrame:
    def f1(p: str, g: str) -> float:
        p, g = ([w for w in x.split(" ") if w] for x in (p, g))
        same = (Counter(p) & Counter(g)).total()
        return 2.0 * same / (len(p) + len(g)) if same else 0.0

    em = ((predicted == gold) & some).astype(float)
    return pd.DataFrame({"em": em, "f1": pd.Series([f1(p, g) for p, g in zip(predicted, gold)], index=em.index, dtype=float)})


def mean_scores(per_query: DataFrame) -> DataFrame:
    """One row: ``em`` and ``f1`` over all queries, rounded to 4."""
    return per_query.agg(F.round(F.avg("em"), 4).alias("em"), F.round(F.avg("f1"), 4).alias("f1"))


def metric_stats(df: DataFrame, by: str, value: str) -> DataFrame:
    """(``by``, ``n``, ``mean``, ``std`` of the population, ``low``, ``high``, ``total``)."""
    v = F.col(value)
    return df.groupBy(by).agg(F.count(v).alias("n"), F.avg(v).alias("mean"), F.stddev_pop(v).alias("std"), F.min(v).alias("low"), F.max(v).alias("high"), F.sum(v).alias("total"))


def cache_stats(lookups: DataFrame, by: str) -> DataFrame:
    """(``by``, ``hits``, ``misses``, ``hit_rate``) from rows (by, hit); rate 0 without lookups."""
    hits, n = F.count_if(F.col("hit")), F.count("hit")
    return lookups.groupBy(by).agg(hits.alias("hits"), (n - hits).alias("misses"), F.when(n > 0, hits / n).otherwise(0.0).alias("hit_rate"))


def latest(df: DataFrame, key: str, *order: str) -> DataFrame:
    """The last row of each key by ``order``: what a cache holds after all puts."""
    rest = [c for c in df.columns if c != key]
    return df.groupBy(key).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("__x")).select(key, *(F.col(f"__x.{c}").alias(c) for c in rest))


def unexpired(cache: DataFrame, now: Column, stored: str = "ts", ttl: str = "ttl") -> DataFrame:
    """What is left when the entries past their time to live (seconds, null for ever) are cleared."""
    age = (F.unix_micros(now.cast("timestamp")) - F.unix_micros(F.col(stored).cast("timestamp"))) / 1e6
    return cache.where(F.col(ttl).isNull() | (age <= F.col(ttl)))
