"""Facts, the weighted graph made of them, Personalized PageRank and graph search.

Facts are rows (chunk, s, p, o); edges rows (src, dst, weight).

Defined results: facts with a null subject or object make no edge, and mention only
the other; null chunks mention nothing; equal facts of one chunk count each; empty
tables give empty results.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from recallgrid.functions import scores
from recallgrid.operators import ranking, vectors
from recallgrid.sources.tables import written

#: Up to so many edges, both ways, are sent to every worker as arrays (20 bytes each); beyond, they stay in blocks.
BROADCAST_EDGES = 2_000_000
#: Edges of a block on average (16 bytes each, and 12 a target); a node's edges are all in one.
BLOCK_EDGES = 1 << 18
#: What the largest block sends in a step, in bytes; more queries take further rounds.
ROUND_BYTES = 1 << 27
#: The same for the search by vectors, whose nodes are numbers (12 bytes an edge).
SEARCH_EDGES = 20_000_000
#: Edges that one step of a walk takes up at once.
SLAB_EDGES = 1 << 20


def fact_edges(facts: DataFrame) -> DataFrame:
    """Facts (chunk, s, p, o) -> (``src``, ``dst``, ``weight``): the number of facts between two entities, both ways."""
    ways = facts.select(F.col("s").alias("src"), F.col("o").alias("dst")).unionByName(facts.select(F.col("o").alias("src"), F.col("s").alias("dst")))
    return ways.where("src is not null and dst is not null").groupBy("src", "dst").agg(F.count("*").cast("double").alias("weight"))


def mentions(facts: DataFrame) -> DataFrame:
    """Distinct (``entity``, ``chunk``)."""
    return facts.select(F.explode(F.array("s", "o")).alias("entity"), "chunk").where("chunk is not null and entity is not null").distinct()


def passage_edges(facts: DataFrame) -> DataFrame:
    """From every chunk to each of its entities, of weight 1."""
    return mentions(facts).select(F.col("chunk").alias("src"), F.col("entity").alias("dst"), F.lit(1.0).alias("weight"))


def graph_edges(facts: DataFrame, synonyms: DataFrame | None = None) -> DataFrame:
    """Edges of facts and passages, and synonym edges (src, dst, weight) where given; weights of equal edges add up."""
    both = fact_edges(facts).unionByName(passage_edges(facts))
    both = both.unionByName(synonyms.select("src", "dst", "weight")) if synonyms is not None else both
    return both.groupBy("src", "dst").agg(F.sum("weight").alias("weight"))


def nodes(facts: DataFrame) -> DataFrame:
    """(``name``, ``kind``): entities and chunks."""
    entities = facts.select(F.explode(F.array("s", "o")).alias("name")).where("name is not null").distinct().withColumn("kind", F.lit("entity"))
    return entities.unionByName(facts.select(F.col("chunk").alias("name")).where("name is not null").distinct().withColumn("kind", F.lit("chunk")))


def new_facts(facts: DataFrame, known: DataFrame) -> DataFrame:
    """The facts of chunks that aren't vertices (name) yet."""
    return facts.join(known.select(F.col("name").alias("chunk")).distinct(), "chunk", "left_anti").select(*facts.columns)


def valid_edges(edges: DataFrame, known: DataFrame) -> DataFrame:
    """The edges without self loops whose ends are both vertices (name)."""
    names = known.select("name").distinct()
    kept = edges.where("src <> dst")
    for end in ("src", "dst"):
        kept = kept.join(names.withColumnRenamed("name", end), end, "left_semi")
    return kept.select(*edges.columns)


def strong_edges(edges: DataFrame, least: float = 0.01) -> DataFrame:
    return edges.where(F.col("weight") >= least)


def degree_importance(edges: DataFrame) -> DataFrame:
    """(``node``, ``degree``, ``importance``): out-edges, and their share of all."""
    degree = edges.groupBy(F.col("src").alias("node")).agg(F.count("*").alias("degree"))
    return degree.crossJoin(degree.agg(F.sum("degree").alias("__all"))).select("node", "degree", (F.col("degree") / (F.col("__all") + 1e-8)).alias("importance"))  # one row


def fact_chunks(facts: DataFrame) -> DataFrame:
    """(s, p, o, chunk): in which chunks each fact, in plain form, stands; a row each, so that a fact of many chunks is no long list."""
    from recallgrid.functions.text import plain

    return facts.select(*(plain(F.col(c)).alias(c) for c in ("s", "p", "o")), "chunk").where("chunk is not null").distinct()


def graph_info(facts: DataFrame, synonyms: DataFrame | None = None) -> DataFrame:
    """One row: phrase, passage and all nodes; distinct facts; edges that touch a passage; all other edges beyond the facts (negative where facts have no edge of their own); all edges."""
    kinds = nodes(facts).agg(F.count_if(F.col("kind") == "entity").alias("phrase_nodes"), F.count_if(F.col("kind") == "chunk").alias("passage_nodes"))
    stated = facts.agg(F.count_distinct(F.struct("s", "p", "o")).alias("extracted_triples"))
    touching = passage_edges(facts).agg(F.count("*").alias("passage_triples"))
    every = graph_edges(facts, synonyms).agg(F.count("*").alias("total_triples"))
    one = kinds.crossJoin(stated).crossJoin(touching).crossJoin(every)  # one row each
    return one.withColumn("total_nodes", F.col("phrase_nodes") + F.col("passage_nodes")).withColumn("synonym_triples", F.col("total_triples") - F.col("extracted_triples") - F.col("passage_triples"))


def usable(edges: DataFrame) -> DataFrame:
    """The edges (src, dst, weight) with two ends and a positive weight."""
    return edges.where("weight > 0 and src is not null and dst is not null").select("src", "dst", "weight")


def transitions(edges: DataFrame) -> DataFrame:
    """(``src``, ``dst``, ``p``) of the undirected graph: parallel edges add up, whichever way; weights that are null or not positive are left out."""
    good = usable(edges)
    both = good.unionByName(good.where("src <> dst").select(F.col("dst").alias("src"), F.col("src").alias("dst"), "weight"))
    w = both.groupBy("src", "dst").agg(F.sum("weight").alias("weight"))
    total = w.groupBy("src").agg(F.sum("weight").alias("total"))
    return w.join(total, "src").select("src", "dst", (F.col("weight") / F.col("total")).alias("p"))


def steps_for(tolerance: float, damping: float) -> int:
    """Steps after which the ranks are off by no more than the tolerance in sum: each step shrinks the rest by the damping."""
    return max(1, math.ceil(math.log(tolerance) / math.log(damping)))


def ppr(edges: DataFrame, reset: DataFrame, damping: float = 0.5, tolerance: float = 1e-6, broadcast_edges: int = BROADCAST_EDGES, block_edges: int = BLOCK_EDGES, round_bytes: int = ROUND_BYTES) -> DataFrame:
    """(``query_id``, ``node``, ``score``) of all queries at once over the undirected weighted graph; scores of a query sum to 1.

    ``reset``: (query_id, node, r).  Null, NaN and negative weights count as 0, repeated nodes add up, and each query's
    weights are scaled to sum to 1; a query without any weight has no rows.  What nodes without edges hold goes back to the reset.  Nodes of score 0 have no row."""
    e = written(usable(edges), "edges")
    guarded = reset.where("node is not null").select("query_id", "node", scores.guarded(F.col("r").cast("double")).alias("r")).where("r > 0").groupBy("query_id", "node").agg(F.sum("r").alias("r"))
    total = guarded.groupBy("query_id").agg(F.sum("r").alias("__all"))
    r = written(guarded.join(total, "query_id").select("query_id", "node", (F.col("r") / F.col("__all")).alias("r")), "reset")
    n, both = steps_for(tolerance, damping), 2 * e.count()
    if both <= broadcast_edges:
        p = written(transitions(e), "steps")
        found, names = _ppr_arrays(p, r, damping, n), p.select(F.col("src").alias("node")).distinct()
    else:
        found, names = _ppr_blocks(e, r, damping, n, -(-both // block_edges), round_bytes)
    # a reset node without edges returns its mass, of which it gets its share again, and so on
    lonely = r.join(names.select("node"), "node", "left_anti").groupBy("query_id").agg(F.sum("r").alias("__lonely"))
    scale = 1 / (1 - damping * F.coalesce("__lonely", F.lit(0.0)))
    return found.join(lonely, "query_id", "left").select("query_id", "node", (F.col("score") * scale).alias("score"))


def _ppr_arrays(p: DataFrame, r: DataFrame, damping: float, n: int) -> DataFrame:
    """Every query by itself on the arrays of the graph."""
    rows = p.toPandas()
    names, at = np.unique(np.concatenate([rows["src"].to_numpy(object), rows["dst"].to_numpy(object)]).astype(object), return_inverse=True) if len(rows) else (np.zeros(0, object), np.zeros(0, np.int64))
    src, dst = at[: len(rows)].astype(np.int32), at[len(rows) :].astype(np.int32)
    shared = r.sparkSession.sparkContext.broadcast((names, src, dst, rows["p"].to_numpy(float)))

    def run(own: pd.DataFrame) -> pd.DataFrame:
        names, src, dst, prob = shared.value
        query, asked = own["query_id"].iloc[0], own["node"].to_numpy(object)
        place = np.searchsorted(names, asked) if len(names) else np.zeros(len(asked), np.int64)
        known = np.array([i < len(names) and names[i] == a for i, a in zip(place.tolist(), asked)], bool)
        start = np.zeros(len(names))
        start[place[known]] = own["r"].to_numpy(float)[known]
        x = start.copy()
        for _ in range(n):
            x = (1 - damping) * start + damping * np.bincount(dst, x[src] * prob, len(names))
        some = np.flatnonzero(x > 0)
        alone = pd.DataFrame({"node": asked[~known], "score": own["r"].to_numpy(float)[~known] * (1 - damping)})
        out = pd.concat([pd.DataFrame({"node": names[some], "score": x[some]}), alone]) if len(alone) else pd.DataFrame({"node": names[some], "score": x[some]})
        return out.assign(query_id=query)[["query_id", "node", "score"]]

    kind, node = (r.schema[c].dataType.simpleString() for c in ("query_id", "node"))
    return r.groupBy("query_id").applyInPandas(run, f"query_id {kind}, node {node}, score double")


def _ppr_blocks(e: DataFrame, r: DataFrame, damping: float, n: int, blocks: int, round_bytes: int) -> tuple[DataFrame, DataFrame]:
    """The ranks, and the nodes with edges (node).

    Nodes are numbered within ``blocks``, each of which keeps the edges of its nodes as arrays; a step sends what nodes pass
    on to the blocks of their targets, a row of arrays for each two blocks and query, and is one exchange without a join of
    rows.  So many queries walk at once as ``round_bytes`` allows.  Neither ranks nor edges go to the driver."""
    spark = e.sparkSession
    ends = e.select(F.col("src").alias("node")).unionByName(e.select(F.col("dst").alias("node")))
    names = written(ends.distinct().repartition(blocks, "node").select("node", F.monotonically_increasing_id().alias("at")), "nodes")  # block and place in it
    low = (1 << 33) - 1
    # numbers that the exchange deals out one to each partition
    ids = spark.range(64 * blocks).select(F.col("id").cast("int").alias("id"))
    dealt = dict(map(tuple, ids.groupBy(F.pmod(F.hash("id"), F.lit(blocks))).agg(F.min("id")).collect()))
    keys = [dealt.get(b, -1 - b) for b in range(blocks)]
    block = F.shiftright("at", 33).cast("int").alias("block")
    size = {keys[b]: k for b, k in map(tuple, names.groupBy(block).count().collect())}  # a row a block
    coded = names.withColumn("block", block).join(F.broadcast(spark.createDataFrame(list(enumerate(keys)), "block int, key int")), "block").select("node", "at", "key")

    ends = (coded.select(F.col("node").alias(c), F.col("at").alias(f"__{c}"), F.col("key").alias(f"__key_{c}")) for c in ("src", "dst"))
    both = e.join(next(ends), "src").join(next(ends), "dst")
    way = lambda a, b: F.struct(F.col(f"__key_{a}").alias("key"), F.col(f"__{a}").alias("src"), F.col(f"__{b}").alias("dst"))
    ways = F.when(F.col("__src") == F.col("__dst"), F.array(way("src", "dst"))).otherwise(F.array(way("src", "dst"), way("dst", "src")))
    w = both.select(F.explode(ways).alias("e"), "weight").select("e.*", "weight").repartition(blocks, "key").groupBy("key", "src", "dst").agg(F.sum("weight").cast("double").alias("weight"))
    # rows of arrays: q is the query or, below 0, minus the number of edges
    schema = "key int, q int, a binary, b binary, c binary, d binary"
    rows_of = pa.schema([("key", pa.int32()), ("q", pa.int32()), *((c, pa.binary()) for c in "abcd")])

    def table(rows: list[tuple], kept: pa.Schema) -> pa.Table:
        return pa.Table.from_arrays([pa.array([x[i] for x in rows], f.type) for i, f in enumerate(kept)], schema=kept)

    def edges_of(key: tuple, rows: pa.Table) -> pa.Table:
        """The edges of a block by target, in slabs: sources, weights, where each target begins, targets."""
        src, dst, weight = (rows.column(c).to_numpy() for c in ("src", "dst", "weight"))
        src = src & low
        p = weight / np.bincount(src, weight)[src]
        order = np.argsort(dst, kind="stable")
        src, dst, p = src[order].astype(np.int32), dst[order], p[order]
        found = []
        for at in range(0, len(src), SLAB_EDGES):
            own = dst[at : at + SLAB_EDGES]
            begin = np.flatnonzero(np.r_[True, own[1:] != own[:-1]])
            found.append((key[0].as_py(), -len(own), src[at : at + SLAB_EDGES].tobytes(), p[at : at + SLAB_EDGES].tobytes(), begin.tobytes(), own[begin].tobytes()))
        return table(found, rows_of)

    def reset_of(key: tuple, rows: pa.Table) -> pa.Table:
        q, at, share = (rows.column(c).to_numpy() for c in ("q", "at", "r"))
        order = np.argsort(q, kind="stable")
        q, at, share = q[order], (at[order] & low).astype(np.int32), share[order]
        cut = np.flatnonzero(np.r_[True, q[1:] != q[:-1], True])
        return table([(key[0].as_py(), int(q[i]), at[i:j].tobytes(), share[i:j].tobytes(), None, None) for i, j in zip(cut[:-1], cut[1:])], rows_of)

    def ranks(key: int, held: pa.Table, moved: pa.Table | None):
        """(query, ranks of the block's nodes); without ``moved`` those of the reset."""
        parts: dict = {}
        for t, of in ((held, 1 - damping if moved is not None else 1.0), (moved, damping)):
            if t is not None and t.num_rows:
                for q, at, x in zip(*(t.column(c).to_pylist() for c in ("q", "a", "b"))):
                    if q >= 0:
                        parts.setdefault(q, []).append((at, x, of))
        for q, own in parts.items():
            y = np.zeros(size[key])
            for at, x, of in own:
                y[np.frombuffer(at, np.int32)] += of * np.frombuffer(x)
            yield q, y

    def sent(key: tuple, held: pa.Table, moved: pa.Table | None = None) -> pa.Table:
        rows = zip(*(held.column(c).to_pylist() for c in ("q", *"abcd")))
        slabs = [tuple(np.frombuffer(x, kind) for x, kind in zip(row[1:], (np.int32, float, np.int64, np.int64))) for row in rows if row[0] < 0]
        found = []
        for q, y in ranks(key[0].as_py(), held, moved):
            for src, p, begin, to in slabs:
                v = np.add.reduceat(y[src] * p, begin)
                some = np.flatnonzero(v)
                if not len(some):
                    continue
                v, to = v[some], to[some]
                place, at = to >> 33, (to & low).astype(np.int32)
                cut = np.flatnonzero(np.r_[True, place[1:] != place[:-1], True])
                found += [(keys[place[i]], q, at[i:j].tobytes(), v[i:j].tobytes()) for i, j in zip(cut[:-1].tolist(), cut[1:].tolist())]
        return table(found, pa.schema(list(rows_of)[:4]))

    def last(key: tuple, held: pa.Table, moved: pa.Table) -> pa.Table:
        first, found = keys.index(key[0].as_py()) << 33, []
        for q, y in ranks(key[0].as_py(), held, moved):
            some = np.flatnonzero(y > 0)
            found.append(pa.table({"q": pa.array(np.full(len(some), q, np.int32)), "at": pa.array(some + first), "score": pa.array(y[some])}))
        return pa.concat_tables(found) if found else table([], pa.schema([("q", pa.int32()), ("at", pa.int64()), ("score", pa.float64())]))

    blocked = written(w.groupBy("key").applyInArrow(edges_of, schema), "blocks")
    asked = written(ranking.numbered(r.select("query_id").distinct(), ["query_id"], "q").select("query_id", F.col("q").cast("int").alias("q")), "asked")
    start = written(r.join(asked, "query_id").join(coded, "node", "left").select("query_id", "q", "node", "at", "key", "r"), "start")
    alone = start.where("key is null").select("query_id", "node", (F.col("r") * (1 - damping)).alias("score"))
    found = alone
    largest = -blocked.groupBy("key").agg(F.sum("q").alias("q")).agg(F.min("q")).first()[0]
    width = max(1, round_bytes // (12 * largest))
    for at in range(0, asked.count(), width):
        own = start.where(F.col("key").isNotNull() & F.col("q").between(at, at + width - 1)).select("key", "q", "at", "r")
        held = blocked.unionByName(own.groupBy("key").applyInArrow(reset_of, schema)).repartition(blocks, "key").persist()
        x = held.groupBy("key").applyInArrow(lambda key, held: sent(key, held), "key int, q int, a binary, b binary")
        for _ in range(n - 1):
            x = held.groupBy("key").cogroup(x.groupBy("key")).applyInArrow(sent, "key int, q int, a binary, b binary")
        x = written(held.groupBy("key").cogroup(x.groupBy("key")).applyInArrow(last, "q int, at long, score double"), "ranks")
        held.unpersist()
        found = found.unionByName(x.join(names, "at").join(asked, "q").select("query_id", "node", "score"))
    return found, names


def phrase_weights(selected: DataFrame, mentioned: DataFrame, most: int = 5) -> DataFrame:
    """(``query_id``, ``node``, ``r``) of the ``most`` best phrases of each query.

    ``selected``: (query_id, s, o, score).  Each occurrence of a phrase as subject or object counts the fact's score over
    the number of chunks that mention it (phrases that aren't in the graph are skipped); a phrase weighs their mean."""
    counts = mentioned.groupBy("entity").agg(F.count("*").alias("chunks"))
    each = selected.select("query_id", F.explode(F.array("s", "o")).alias("entity"), "score").where("entity is not null")
    mean = each.join(counts, "entity").groupBy("query_id", "entity").agg(F.avg(F.col("score") / F.col("chunks")).alias("r"))
    return ranking.top_each(mean, most, "r", "entity").select("query_id", F.col("entity").alias("node"), "r")


def graph_search(facts: DataFrame, edges: DataFrame, fact_scores: DataFrame, passage_scores: DataFrame, density: DataFrame, link_top_k: int = 5, most: int = 100, damping: float = 0.5) -> DataFrame:
    """(``query_id``, ``id``, ``rank``, ``score``, ``path``): every passage of each query.

    ``fact_scores``: (query_id, s, p, o, score) and ``passage_scores``: (query_id, id, score), each scaled to 0..1 within
    a query here; ``density``: (id, density).  The best facts weigh their phrases and, by their mean score, the passages;
    PageRank from both ranks the passages, of which the first ``most`` are ranked anew by evidence (``path`` graph).
    Queries whose facts are too weak get the passages by their own scores (``path`` dense); passages that PageRank doesn't reach score 0."""
    scaled = scores.minmax_by(fact_scores.withColumn("id", F.concat_ws("|", "s", "p", "o")), "score", "__s", "query_id").drop("score").withColumnRenamed("__s", "score")
    best = written(ranking.top_each(scaled, link_top_k), "linked")
    dense = written(scores.minmax_by(passage_scores.select("query_id", "id", "score"), "score", "__s", "query_id").select("query_id", "id", F.col("__s").alias("score")), "dense")
    judged = passage_scores.select("query_id").distinct().join(best.groupBy("query_id").agg(F.count("*").alias("n"), F.avg("score").alias("mean")), "query_id", "left")
    weak = scores.needs_fallback(F.coalesce("n", F.lit(0)), F.coalesce("mean", F.lit(0.0)), F.lit(1.0))
    judged = written(judged.select("query_id", weak.alias("weak"), scores.adaptive_weight(F.coalesce("mean", F.lit(0.0)), F.lit(0.5), F.lit(0.5)).alias("share")), "judged")
    strong = judged.where("not weak").drop("weak")
    phrases = phrase_weights(best.join(strong.select("query_id"), "query_id", "left_semi"), mentions(facts), link_top_k)
    passages = dense.join(strong, "query_id").select("query_id", F.col("id").alias("node"), (F.col("score") * F.col("share")).alias("r"))
    reached = ppr(edges, phrases.unionByName(passages), damping).withColumnRenamed("node", "id")
    every = dense.join(strong.select("query_id"), "query_id", "left_semi").select("query_id", "id").join(reached, ["query_id", "id"], "left").select("query_id", "id", F.round(F.coalesce("score", F.lit(0.0)), 9).alias("score"))
    found = ranking.evidence_rerank(ranking.ranked(every), density, most).withColumn("path", F.lit("graph"))
    other = ranking.ranked(dense.join(judged.where("weak").select("query_id"), "query_id", "left_semi")).select("query_id", "id", "rank", "score").withColumn("path", F.lit("dense"))
    return found.unionByName(other)


def _slabs(src: np.ndarray, dst: np.ndarray, p: np.ndarray) -> list[tuple]:
    """Edges by target in slabs: (sources, weights, where each target begins, targets)."""
    order = np.argsort(dst, kind="stable")
    src, dst, p = src[order].astype(np.int32), dst[order].astype(np.int32), p[order]
    found = []
    for at in range(0, len(src), SLAB_EDGES):
        own = dst[at : at + SLAB_EDGES]
        begin = np.flatnonzero(np.r_[True, own[1:] != own[:-1]])
        found.append((src[at : at + SLAB_EDGES], p[at : at + SLAB_EDGES], begin, own[begin]))
    return found


def _walk(slabs: list[tuple], start: np.ndarray, damping: float, n: int) -> np.ndarray:
    """The nodes' ranks for one query after n steps from its reset ``start``."""
    x, y = start.copy(), np.empty_like(start)
    for _ in range(n):
        np.multiply(start, 1 - damping, out=y)
        for src, p, begin, to in slabs:
            y[to] += damping * np.add.reduceat(x[src] * p, begin)
        x, y = y, x
    return x


def _minmax(x: np.ndarray) -> np.ndarray:
    lo, hi = x.min(), x.max()
    return np.ones(len(x)) if hi - lo < 1e-10 else (x - lo) / (hi - lo)


def graph_search_by_vectors(facts: DataFrame, passages: DataFrame, edges: DataFrame, keys: DataFrame, queries: DataFrame, link_top_k: int = 5, most: int = 100, damping: float = 0.5, tolerance: float = 1e-6, id_col: str = "vec_id", vec_col: str = "embedding", search_edges: int = SEARCH_EDGES) -> DataFrame:
    """:func:`graph_search` where the scores are cosines: (``query_id``, ``id``, ``rank``, ``score``, ``path``).

    ``facts``: (chunk, s, p, o, vec_id) and ``passages``: (id, vec_id, density; distinct ids), whose vectors are in ``keys``
    (distinct vec_id, embedding); those without one aren't scored.  Every worker has graph and vectors as arrays and answers
    its queries from beginning to end, so that no row a query and passage is exchanged or written in between; larger graphs
    than ``search_edges`` take the scores as rows."""
    f, ps = facts.select("chunk", "s", "p", "o", F.col("vec_id").cast("long").alias("vec_id")), passages.select("id", F.col("vec_id").cast("long").alias("vec_id"), "density")
    p = written(transitions(edges), "steps")
    if p.count() > search_edges:
        near = vectors.knn_join(queries, keys, keys.count(), id_col=id_col, vec_col=vec_col).select("query_id", F.col("key_id").alias("vec_id"), "score")
        return graph_search(f.select("chunk", "s", "p", "o"), edges, f.join(near, "vec_id").select("query_id", "s", "p", "o", "score"), ps.join(near, "vec_id").select("query_id", "id", "score"), ps.select("id", "density"), link_top_k, most, damping)
    ends = [p.select(F.col("src").alias("name")), ps.select(F.col("id").alias("name")), f.select(F.explode(F.array("s", "o")).alias("name"))]
    names = ends[0].unionByName(ends[1]).unionByName(ends[2]).where("name is not null").distinct()
    names = written(ranking.numbered(names, ["name"], "code").select("name", F.col("code").cast("int").alias("code")), "names")  # in the order of names

    def coded(df: DataFrame, *cols: str) -> DataFrame:
        for c in cols:
            df = df.join(names.select(F.col("name").alias(c), F.col("code").alias(f"__{c}")), c, "left")
        return df

    def arrays(df: DataFrame) -> list[np.ndarray]:
        return [c.to_numpy() for c in df.toArrow().columns]

    usable = vectors._usable(keys, id_col, vec_col)
    q = vectors._usable(queries, id_col, vec_col)
    rows = usable.orderBy("id").toArrow()
    ids, unit = rows.column("id").to_numpy(), vectors._unit(vectors._matrix(rows.column("v")), "cosine")
    src, dst, prob = arrays(coded(p, "src", "dst").select("__src", "__dst", "p"))
    known = usable.select(F.col("id").alias("vec_id"))
    fact = arrays(coded(f.join(known, "vec_id", "left_semi"), "s", "o").orderBy(F.concat_ws("|", "s", "p", "o")).select(F.coalesce("__s", F.lit(-1)), F.coalesce("__o", F.lit(-1)), "vec_id"))
    said = coded(ps.join(known, "vec_id", "left_semi"), "id").orderBy("__id").select("__id", "vec_id", F.coalesce(F.col("density").cast("double"), F.lit(0.0)), "id").toArrow()
    place, vec, density = (said.column(i).to_numpy() for i in range(3))
    entity, chunks = arrays(coded(mentions(f).groupBy("entity").agg(F.count("*").alias("n")), "entity").select("__entity", "n"))
    count = names.count()
    mentioned = np.zeros(count)
    mentioned[entity] = chunks
    lonely = np.ones(count, bool)
    lonely[src] = False
    label = said.column("id").combine_chunks()
    label = label.cast(pa.large_string()) if isinstance(label, pa.Array) else pa.array([], pa.large_string())
    shared = q.sparkSession.sparkContext.broadcast((unit, _slabs(src, dst, prob), fact[0], fact[1], np.searchsorted(ids, fact[2]), place, np.searchsorted(ids, vec), density, label, mentioned, lonely))
    steps, width = steps_for(tolerance, damping), 8

    def phrases(top: np.ndarray, sim: np.ndarray, s: np.ndarray, o: np.ndarray, mentioned: np.ndarray) -> list[tuple]:
        each: dict = {}
        for i in top.tolist():
            for e in (int(s[i]), int(o[i])):
                if e >= 0 and mentioned[e]:
                    each.setdefault(e, []).append(sim[i] / mentioned[e])
        return sorted(((e, sum(x) / len(x)) for e, x in each.items()), key=lambda x: (-x[1], x[0]))[:link_top_k]

    def answered(qi, order, score, label, path: str):
        for at in range(0, len(order), 50_000):
            own = order[at : at + 50_000]
            n = len(own)
            yield pa.RecordBatch.from_arrays([pa.repeat(qi, n), label.take(pa.array(own)).cast(pa.string()), pa.array(np.arange(at + 1, at + n + 1, dtype=np.int32)), pa.array(score[own]), pa.repeat(path, n)], names=["query_id", "id", "rank", "score", "path"])

    def run(batches):
        unit, slabs, s, o, fact_at, place, at, density, label, mentioned, lonely = shared.value
        for b in batches:
            for first in range(0, b.num_rows if len(place) else 0, width):
                part = b.slice(first, width)
                asked = pa.array(part.column(0))
                every = vectors._scores(vectors._unit(vectors._matrix(part.column(1)), "cosine"), unit, "cosine")
                for qi, cos in zip(asked, every):
                    dense = _minmax(cos[at])
                    sim = _minmax(cos[fact_at]) if len(fact_at) else np.zeros(0)
                    bar = np.partition(sim, len(sim) - link_top_k)[len(sim) - link_top_k] if len(sim) > link_top_k else -np.inf
                    top = np.flatnonzero(sim >= bar)
                    top = top[np.argsort(-sim[top], kind="stable")][:link_top_k]  # ties go to the first in the order of facts
                    mean = float(sim[top].mean()) if len(top) else 0.0
                    if not len(top) or mean < 0.4:  # scores.needs_fallback
                        yield from answered(qi, np.argsort(-dense, kind="stable"), dense, label, "dense")
                        continue
                    start = np.zeros(len(mentioned))
                    start[place] = dense * min(0.5, max(0.1, 0.2 + 0.3 * (0.5 - mean)))  # scores.adaptive_weight
                    for e, weight in phrases(top, sim, s, o, mentioned):
                        start[e] += weight
                    start /= start.sum() or 1.0
                    x = _walk(slabs, start, damping, steps)[place] / (1 - damping * start[lonely].sum())
                    score = np.floor(x * 1e9 + 0.5) / 1e9
                    order = np.argsort(-score, kind="stable")
                    head = np.sort(order[:most])
                    m, d = _minmax(score[head]), density[head]
                    score[head] = 0.3 * m * d + 0.7 * (0.5 * m + 0.5 * d)  # text.evidence
                    order[: len(head)] = head[np.argsort(-score[head], kind="stable")]
                    yield from answered(qi, order, score, label, "graph")

    n = q.count()
    tasks = max(1, min(-(-n // width), 8 * q.sparkSession.sparkContext.defaultParallelism))
    return q.repartition(tasks).mapInArrow(run, "query_id long, id string, rank int, score double, path string")
