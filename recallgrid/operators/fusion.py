"""Rank fusion of two rankings (query_id, id, score).

Defined results: an id missing on one side adds nothing there; of an id that one
list holds more than once the best place counts; ties in a list go to the smaller
id; a null score ranks last and adds nothing; empty lists give the other list.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from recallgrid.functions import scores
from recallgrid.operators import ranking


def _side(df: DataFrame, name: str, method: str) -> DataFrame:
    own = df.groupBy("query_id", "id").agg(F.max("score").alias("score"))
    if method == "weighted":
        return own.select("query_id", "id", F.coalesce(F.col("score").cast("double"), F.lit(0.0)).alias(name))
    return ranking.ranked(own).select("query_id", "id", (F.col("rank") - 1).cast("double").alias(name))


def fuse(a: DataFrame, b: DataFrame, method: str = "weighted", wa: float = 0.5, wb: float = 0.5) -> DataFrame:
    """(query_id, id, ``score``): weighted sum of scores, reciprocal rank w / (rank + 1), or Borda w * (n - rank), with ranks
    from 0; n is the two lists' joint length.  An unknown method is the weighted sum."""
    return _fused(a, b, method, lambda df: df.withColumns({"wa": F.lit(wa), "wb": F.lit(wb)})).select("query_id", "id", "score")


def _fused(a: DataFrame, b: DataFrame, method: str, weigh) -> DataFrame:
    method = method if method in ("rrf", "borda") else "weighted"
    both = weigh(_side(a, "a", method).join(_side(b, "b", method), ["query_id", "id"], "full_outer"))
    if method == "borda":
        n = a.select("query_id", "id").distinct().unionAll(b.select("query_id", "id").distinct()).groupBy("query_id").agg(F.count("*").alias("__n"))
        both = both.join(n, "query_id")
    part: dict[str, Column] = {"weighted": lambda w, x: w * x, "rrf": lambda w, x: w / (x + 1), "borda": lambda w, x: w * (F.col("__n") - x)}[method]
    return both.withColumn("score", sum(F.coalesce(part(F.col(f"w{s}"), F.col(s)), F.lit(0.0)) for s in ("a", "b")))


def confidences(a: DataFrame, b: DataFrame) -> DataFrame:
    """(query_id, ``ca``, ``cb``, ``wa``, ``wb``): how sure each list is of its first, and the weights that follow; the history of a fusion."""
    one, two = (ranking.score_gap(x).select("query_id", scores.confidence(F.col("first"), F.col("second")).alias(c)) for x, c in ((a, "ca"), (b, "cb")))
    both = one.join(two, "query_id", "full_outer").withColumns({c: F.coalesce(c, F.lit(0.5)) for c in ("ca", "cb")})
    wa, wb = scores.fusion_weights(F.col("ca"), F.col("cb"))
    return both.withColumns({"wa": wa, "wb": wb})


def fuse_adaptive(a: DataFrame, b: DataFrame, method: str = "weighted", sure: float = 0.95) -> DataFrame:
    """(query_id, id, ``score``, ``path``): fused by the weights of :func:`confidences`; where one list is surer than ``sure``, that
    list alone with its own scores (``path`` a or b, else fused), the surer one if both are."""
    known = confidences(a, b)
    pick = F.when(F.greatest("ca", "cb") > sure, F.when(F.col("ca") > F.col("cb"), "a").otherwise("b")).otherwise("fused")
    known = known.withColumn("path", pick)
    fused = _fused(a, b, method, lambda df: df.join(known.where("path = 'fused'").select("query_id", "wa", "wb"), "query_id")).select("query_id", "id", "score", F.lit("fused").alias("path"))
    for side, name in ((a, "a"), (b, "b")):
        own = side.groupBy("query_id", "id").agg(F.max("score").cast("double").alias("score")).join(known.where(F.col("path") == name).select("query_id"), "query_id", "left_semi")
        fused = fused.unionByName(own.select("query_id", "id", "score", F.lit(name).alias("path")))
    return fused


def fuse_dense_graph(dense: DataFrame, graph: DataFrame, share: float = 0.2) -> DataFrame:
    """(query_id, id, ``score``) of two scorings of the same ids: each scaled to 0..1 within a query, ``share`` of the dense one."""
    one, two = (scores.minmax_by(x, "score", c, "query_id").select("query_id", "id", c) for x, c in ((dense, "d"), (graph, "g")))
    return one.join(two, ["query_id", "id"]).select("query_id", "id", (share * F.col("d") + (1 - share) * F.col("g")).alias("score"))
