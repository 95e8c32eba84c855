"""Rankings (query_id, id, score): top-k, full order, rerank of the head.

Defined results: ties go to the smaller id; null scores come last; empty rankings
give empty results; repeated ids are ranked as they come.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from recallgrid.functions import scores, text


def ordered(score: str = "score", id_col: str = "id", by: str = "query_id"):
    return Window.partitionBy(by).orderBy(F.desc_nulls_last(score), id_col)


def top(df: DataFrame, k: int, score: str = "score", id_col: str = "id") -> DataFrame:
    """The k best rows of all (fewer if there are fewer)."""
    return df.orderBy(F.desc_nulls_last(score), id_col).limit(k)


def top_each(df: DataFrame, k: int, score: str = "score", id_col: str = "id", by: str = "query_id") -> DataFrame:
    """The k best rows of each query with ``rank`` from 1; only k rows a query leave a task."""
    return df.withColumn("rank", F.row_number().over(ordered(score, id_col, by))).where(F.col("rank") <= k)


def ranked(df: DataFrame, score: str = "score", id_col: str = "id", by: str = "query_id") -> DataFrame:
    """Every row with its ``rank`` from 1."""
    return df.withColumn("rank", F.row_number().over(ordered(score, id_col, by)))


def numbered(df: DataFrame, order: list[str], out: str) -> DataFrame:
    """``df`` with numbers from 0 in order: sorted in ranges, whose sizes give the first number of each."""
    from recallgrid.sources.tables import written

    places = F.monotonically_increasing_id()
    sorted_ = written(df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("__at", places), "numbered")
    part, row = F.shiftright("__at", 33), F.col("__at").bitwiseAND((1 << 33) - 1)
    sizes = sorted_.groupBy(part.alias("__part")).agg(F.count("*").alias("n"))
    before = sizes.select("__part", (F.sum("n").over(Window.orderBy("__part")) - F.col("n")).alias("__before"))  # a row a partition
    return sorted_.withColumn("__part", part).join(F.broadcast(before), "__part").withColumn(out, F.col("__before") + row).drop("__part", "__at", "__before")


def score_gap(df: DataFrame) -> DataFrame:
    """(``query_id``, ``first``, ``second``, ``gap``): the two best scores of each query; null where there is no second."""
    best = top_each(df, 2).groupBy("query_id").agg(F.max(F.when(F.col("rank") == 1, F.col("score"))).alias("first"), F.max(F.when(F.col("rank") == 2, F.col("score"))).alias("second"))
    return best.withColumn("gap", F.col("first") - F.col("second"))


def evidence_rerank(ranking: DataFrame, density: DataFrame, most: int = 100, query_type: str = "general") -> DataFrame:
    """(query_id, id, ``rank``, ``score``): the first ``most`` of each query (query_id, id, rank, score) by the evidence of their
    min-max scaled score and their density (id, density; 0 where there is none); the others stay as they are."""
    head = scores.minmax_by(ranking.where(F.col("rank") <= most), "score", "__s", "query_id").join(density.select("id", "density"), "id", "left")
    judged = head.select("query_id", "id", text.evidence(F.col("__s"), F.coalesce("density", F.lit(0.0)), query_type).alias("score"))
    return ranked(judged).select("query_id", "id", "rank", "score").unionByName(ranking.where(F.col("rank") > most).select("query_id", "id", "rank", "score"))
