"""Worked values and edge cases of the retrieval library."""

import json

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from recallgrid import adapters, prompts
from recallgrid.engine import Engine
from recallgrid.functions import scores, text
from recallgrid.operators import fusion, graph, metrics, openie, passages, ranking, store, vectors
from recallgrid.plans.queries import QUERIES, SQL
from recallgrid.sources import tables
from recallgrid.streaming import memory


def one(spark, *cols):
    return spark.range(1).select(*cols).first()


def rows(df, *cols):
    return sorted((tuple(r) for r in (df.select(*cols) if cols else df).collect()), key=str)


def test_density_terms(spark):
    texts = ["Marie Curie was born in Warsaw in 1867. NASA is 12 km away.", "El Niño y La Niña: 5km 3.5 kg 2020年 位于北京是", "", None, "a the of", "ABC DEF Ab"]
    got = [r for r in text.with_density(spark.createDataFrame(list(enumerate(texts)), "i int, text string")).orderBy("i").collect()]
    assert [r["entities"] for r in got] == [5, 5, 0, None, 0, 2]  # Marie Curie, Warsaw, NASA, 1867, 12 km; El, La, 5km, 3.5 kg, 2020年, none for Niño
    assert [r["facts"] for r in got] == [2, 2, 0, None, 0, 0]
    assert got[2]["density"] == got[3]["density"] == 0 and abs(got[4]["richness"] - 0.4) < 1e-9 and abs(got[4]["length_score"] - 8 / 350) < 1e-9


def test_worked_values(spark):
    l = F.lit
    r = one(spark, text.evidence(l(0.9), l(0.8)), text.evidence(l(0.9), l(0.2)), text.evidence(l(0.3), l(0.8)), text.evidence(l(0.9), l(0.2), "factual"))
    assert np.allclose(list(r), [0.811, 0.439, 0.457, 0.3 * 0.18 + 0.7 * (0.63 + 0.06)])
    r = one(spark, scores.adaptive_weight(l(0.8), l(0.8), l(0.5)), scores.adaptive_weight(l(0.3), l(0.3), l(0.5)), scores.weighted(l(0.5), l(0.7), 0.6, 0.4), scores.multiplicative(l(0.3), l(0.6)))
    assert np.allclose(list(r), [0.1, 0.3, 0.58, 0.369])
    assert list(one(spark, *(scores.needs_fallback(*map(l, x)) for x in ((0, 0.0, 0.0), (5, 0.2, 0.5), (5, 0.7, 0.8))))) == [True, True, False]
    assert list(one(spark, *(scores.guarded(x) for x in (l(float("nan")), l(-1.0), l(None).cast("double"), l(2.0))))) == [0, 0, 0, 2]
    assert list(one(spark, scores.from_distance(l(0.25), "cosine"), scores.from_distance(l(1.0), "l2"), scores.from_distance(l(3.0), "ip"))) == [0.75, 0.5, 3.0]


def test_texts(spark):
    l = F.lit
    q = "What is the capital of France"
    r = one(spark, text.rewritten(l(q)), text.expanded(l(q)), text.decomposed(l("Who wrote A and who wrote B or C")), text.optimised(l("hi")), text.parsed_answer(l("x Answer: y Answer: z")), text.parsed_answer(l("raw")))
    assert r[0] == q and r[1] == ["What", "What is", "What is the"] and r[2] == ["who wrote a", "who wrote b or c"] and r[3] == ["hi"] and r[4] == "y" and r[5] == "raw"
    r = one(spark, text.normalised_answer(l("The  Cat, an é-a!")), text.decoded_escapes(l(r"café 中 \u12")), text.flag(l(" Yes ")), text.flag(l("what")), text.instructed(l("t"), "nvembed", l("do")), text.instruction(l("nope")), text.embedding_text(l(None).cast("string")))
    assert r[0] == "cat éa" and r[1] == "café 中 \\u12" and r[2] is True and r[3] is None and r[4] == "Instruct: do\nQuery: t" and r[5] == text.INSTRUCTIONS["query_to_passage"] and r[6] == " "
    assert one(spark, text.plain_all(F.array(l("A-b"), l("é1"))))[0] == ["a b", "1"]
    df = spark.createDataFrame([(1, "T\na\n"), (2, "T\n\nb"), (3, "U"), (4, None)], "doc_id int, text string")
    assert rows(passages.merged_by_title(df), "head", "n", "merged") == [("T", 2, "Wikipedia Title: T\na\n\nb"), ("U", 1, "Wikipedia Title: U")]


def test_minmax(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", 3.0), ("a", 2.0), (None, 5.0), (None, 5.0)], "q string, x double")
    assert rows(scores.minmax_by(df, "x", "s", "q"), "q", "s") == sorted([("a", 0.0), ("a", 0.5), ("a", 1.0), (None, 1.0), (None, 1.0)], key=str)
    assert rows(scores.minmax_by(df.where("q = 'a'"), "x", "s"), "s") == [(0.0,), (0.5,), (1.0,)] and scores.minmax_by(df.limit(0), "x", "s", "q").count() == 0


def test_store(spark, tmp_path):
    old = spark.createDataFrame([("a", 1), (None, 2)], "id string, v int")
    new = spark.createDataFrame([("a", 9), (None, 9), ("b", 4), ("b", 3)], "id string, v int")
    assert rows(store.insert_if_absent(old, old, "id")) == rows(old)
    assert rows(store.insert_if_absent(old, new, "id")) == sorted([("a", 1), (None, 2), ("b", 3)], key=str)
    assert rows(store.upsert(old, new, "id")) == sorted([("a", 9), (None, 9), ("b", 3)], key=str)
    assert rows(store.delete(old, new.where("id is null"), "id")) == [("a", 1)] and rows(store.missing(old, new, "id")) == [("b",)]
    assert rows(store.lookup(old, new.withColumn("at", F.col("v")), "id", "at"), "id", "found", "v")[0] == ("a", True, 1)
    assert store.upsert(old.limit(0), new, "id").count() == 3
    s = store.Store(spark, f"file://{tmp_path}/s", "id string, v int")
    assert len(s) == 0
    s.insert(new), s.upsert(old), s.delete(new.where("id = 'b'"))
    assert rows(s.load()) == rows(old) and s.exists("a") and not s.exists("b") and s.count() == 2 and rows(s.ids()) == rows(old, "id")
    assert s.clear().count() == 0
    assert rows(store.distinct_ids(new, "id")) == [("a", 0), ("b", 1)]


def test_graph_and_ppr(spark):
    path = spark.createDataFrame([("A", "B", 1.0), ("B", "C", 1.0), ("D", "D", -1.0), (None, "A", 1.0)], "src string, dst string, weight double")
    reset = spark.createDataFrame([(1, "A", 2.0), (1, "A", None), (2, "C", 1.0), (2, "Z", 1.0), (3, "A", float("nan"))], "query_id int, node string, r double")
    for limit in (10**6, 0):  # arrays, and joins
        got = {(r["query_id"], r["node"]): r["score"] for r in graph.ppr(path, reset, tolerance=1e-9, broadcast_edges=limit).collect()}
        assert np.allclose([got[1, n] for n in "ABC"], [7 / 12, 1 / 3, 1 / 12], atol=1e-8) and not any(q == 3 for q, _ in got)
        assert abs(sum(v for (q, _), v in got.items() if q == 2) - 1) < 1e-8 and abs(got[2, "Z"] - 0.5 * 0.5 / 0.75) < 1e-8
        assert graph.ppr(path.limit(0), reset.limit(0), broadcast_edges=limit).count() == 0
    facts = spark.createDataFrame([("c1", "a", "p", "b"), ("c1", "a", "p", "b"), ("c2", "b", "q", "b"), ("c2", None, "q", "d"), (None, "a", "p", "x")], "chunk string, s string, p string, o string")
    assert ("a", "b", 2.0) in rows(graph.fact_edges(facts)) and ("c2", "d", 1.0) in rows(graph.passage_edges(facts))
    assert ("b", "b", 2.0) in rows(graph.graph_edges(facts)) and all(r[0] != r[1] for r in rows(graph.valid_edges(graph.graph_edges(facts), graph.nodes(facts))))
    gone = store.cascade_delete(facts, spark.createDataFrame([("c1",)], "chunk string"))
    assert rows(gone) == [("chunk", "c1"), ("fact", "a|p|b"), ("vertex", "c1")]
    info = graph.graph_info(facts).first()
    assert info["phrase_nodes"] == 4 and info["passage_nodes"] == 2 and info["total_nodes"] == 6
    assert graph.graph_info(facts.limit(0)).first()["total_triples"] == 0


def test_ppr_in_blocks_equals_brute_force(spark):
    rng = np.random.default_rng(3)
    ends = [(f"n{a}", f"n{b}", float(w)) for a, b, w in zip(rng.integers(0, 40, 90), rng.integers(0, 50, 90), rng.integers(1, 4, 90))]
    ends += [("hub", f"n{i}", 1.0) for i in range(30)] + [("n0", "n0", 2.0), ("far", "away", 1.0)]
    asked = [(q, n, float(w)) for q, n, w in (("a", "n0", 1), ("a", "hub", 2), ("b", "far", 1), ("c", "n7", 1), ("c", "none", 3), ("d", "nowhere", 1), (None, "n1", 1))]
    names = sorted({n for a, b, _ in ends for n in (a, b)})
    m = np.zeros((len(names), len(names)))
    for a, b, w in ends:
        i, j = names.index(a), names.index(b)
        m[i, j] += w
        m[j, i] += w * (i != j)
    m /= m.sum(1, keepdims=True)
    want = {}
    for q in "abcd":
        r = {n: w / sum(w for p, _, w in asked if p == q) for p, n, w in asked if p == q}
        start = np.array([r.get(n, 0.0) for n in names])
        x = start
        for _ in range(graph.steps_for(1e-2, 0.5)):
            x = 0.5 * start + 0.5 * x @ m
        lone = {n: w for n, w in r.items() if n not in names}
        scale = 1 / (1 - 0.5 * sum(lone.values()))
        want |= {(q, n): v * scale for n, v in zip(names, x) if v > 0} | {(q, n): w * 0.5 * scale for n, w in lone.items()}
    edges, reset = spark.createDataFrame(ends, "src string, dst string, weight double"), spark.createDataFrame(asked, "query_id string, node string, r double")
    for block, round_bytes in ((40, 12 * 40 * 2), (10**6, graph.ROUND_BYTES)):  # several blocks and rounds, and one of each
        got = graph.ppr(edges, reset, tolerance=1e-2, broadcast_edges=0, block_edges=block, round_bytes=round_bytes).collect()
        found = {(r["query_id"], r["node"]): r["score"] for r in got}
        assert len(got) == len(found) and found.keys() == want.keys()
        assert np.allclose([found[k] for k in want], list(want.values()), rtol=1e-12, atol=1e-15)


def _exchanged(spark, after: int = -1) -> tuple[int, int]:
    """Rows that stages beyond a number have written to exchanges, and the last number."""
    sc = spark.sparkContext
    sc._jsc.sc().listenerBus().waitUntilEmpty()
    stages = sc._jsc.sc().statusStore().stageList(None, False, False, sc._gateway.new_array(sc._jvm.double, 0), sc._jvm.java.util.ArrayList())
    stages = [stages.apply(i) for i in range(stages.size())]
    return sum(x.shuffleWriteRecords() for x in stages if x.stageId() > after), max((x.stageId() for x in stages), default=-1)


def test_ppr_steps_exchange_no_row_a_node(spark):
    edges = spark.range(5000).select(F.concat(F.lit("n"), (F.col("id") % 25).cast("string")).alias("src"), F.concat(F.lit("c"), F.col("id").cast("string")).alias("dst"), F.lit(1.0).alias("weight"))
    reset = spark.createDataFrame([(0, f"n{i}", 1.0) for i in range(25)], "query_id int, node string, r double")
    _, before = _exchanged(spark)
    assert graph.ppr(edges, reset, broadcast_edges=0).count() == 5025
    assert _exchanged(spark, before)[0] < 20 * 5025  # 20 steps; a row a node and step would be more


def test_ppr_20_in_blocks_equals_sql(spark, monkeypatch):
    folder, ppr = "/root/testdata/sf0.01", graph.ppr
    monkeypatch.setattr(graph, "ppr", lambda edges, reset: ppr(edges, reset, broadcast_edges=0, block_edges=2500))
    _, before = _exchanged(spark)
    got = {r["node"]: r["score"] for r in QUERIES["ppr_20"](spark, folder).collect()}
    assert _exchanged(spark, before)[0] < 20 * len(got)  # 20 steps; a row a node and step would be more
    db = duckdb.connect()
    for t in ("customer", "supplier", "nation", "region"):
        db.sql(f"create view {t} as select * from '{folder}/{t}.parquet'")
    assert got == dict(db.execute(SQL["ppr_20"]).fetchall()) and len(got) == 3255


def test_graph_search_falls_back(spark):
    facts = spark.createDataFrame([("c1", "a", "p", "b"), ("c2", "b", "p", "c"), ("c3", "d", "p", "e")], "chunk string, s string, p string, o string")
    scored = spark.createDataFrame([(1, "a", "p", "b", 0.9), (1, "b", "p", "c", 0.8), (1, "d", "p", "e", 0.7)], "query_id int, s string, p string, o string, score double")
    dense = spark.createDataFrame([(q, f"c{i}", i / 10) for q in (1, 2) for i in (1, 2, 3)], "query_id int, id string, score double")
    density = spark.createDataFrame([("c1", 0.5)], "id string, density double")
    got = {(r["query_id"], r["id"]): r for r in graph.graph_search(facts, graph.graph_edges(facts), scored, dense, density).collect()}
    assert {r["path"] for (q, _), r in got.items() if q == 1} == {"graph"} and {r["path"] for (q, _), r in got.items() if q == 2} == {"dense"}
    assert got[2, "c3"]["rank"] == 1 and got[1, "c1"]["rank"] == 1


def test_graph_search_by_vectors_equals_that_by_rows(spark, tmp_path):
    r = np.random.default_rng(5)
    at = lambda n: r.integers(0, n, 30).tolist()
    rows_ = [(f"k{i}", f"a{a}" if i else None, "p", f"a{b}", i % 12) for i, (a, b) in enumerate(zip(at(9), at(9)))]
    facts = spark.createDataFrame(rows_, "chunk string, s string, p string, o string, vec_id long")
    keys = spark.createDataFrame([(i, r.normal(size=4).tolist()) for i in range(11)], "vec_id long, embedding array<double>")  # a vector is missing
    passages = facts.select(F.col("chunk").alias("id"), "vec_id", (F.col("vec_id") / 20).alias("density")).where("id <> 'k7'").unionByName(spark.createDataFrame([("alone", 3, None)], "id string, vec_id long, density double"))
    edges = graph.graph_edges(facts)
    got, rest = (rows(graph.graph_search_by_vectors(facts, passages, edges, keys, keys.where("vec_id < 7"), 3, 8, search_edges=n).withColumn("score", F.round("score", 8))) for n in (10**6, 0))
    assert got == rest and len(got) == 7 * passages.where("vec_id <> 11").count()
    assert graph.graph_search_by_vectors(facts.limit(0), passages.limit(0), edges.limit(0), keys, keys).count() == 0


def test_graph_search_writes_no_row_a_query_and_passage(spark, monkeypatch):
    made = []
    put = lambda df, name: made.append(df) or put_(df, name)
    put_ = tables.written
    for m in (graph, tables):
        monkeypatch.setattr(m, "written", put)
    found = QUERIES["graph_search"](spark, "/root/testdata/sf0.001").count()
    assert found == 1850 and max(df.count() for df in made) < found


def test_fusion_of_the_worked_lists(spark):
    make = lambda ids, s: spark.createDataFrame([(1, f"doc{i}", x) for i, x in zip(ids, s)], "query_id int, id string, score double")
    a, b = make([1, 2, 3, 4, 5], [0.95, 0.85, 0.75, 0.65, 0.55]), make([3, 1, 6, 7, 8], [0.8, 0.7, 0.6, 0.5, 0.4])
    k = fusion.confidences(a, b).first()
    assert np.allclose([k["ca"], k["cb"], k["wa"], k["wb"]], [0.5526, 0.5625, 0.4956, 0.5044], atol=1e-4)
    for method, want in {"weighted": (0.8239, 0.7752, 0.4212), "rrf": (0.7478, 0.6696, 0.2478), "borda": (9.4956, 9.0089, 4.4601), "unknown": (0.8239, 0.7752, 0.4212)}.items():
        best = fusion.fuse_adaptive(a, b, method).orderBy(F.desc("score")).limit(3).collect()
        assert [r["id"] for r in best] == ["doc1", "doc3", "doc2"] and np.allclose([r["score"] for r in best], want, atol=2e-4)
    sure = fusion.fuse_adaptive(make([1, 2], [1.0, 0.05]), b).collect()
    assert {(r["id"], r["score"], r["path"]) for r in sure} == {("doc1", 1.0, "a"), ("doc2", 0.05, "a")}
    assert fusion.fuse_adaptive(make([1, 2], [0.99, 0.5]), b).first()["path"] == "fused"
    twice = a.union(a)
    assert rows(fusion.fuse(twice, b)) == rows(fusion.fuse(a, b)) and fusion.fuse(a, b.limit(0)).count() == 5


def test_evidence_rerank_keeps_the_tail(spark):
    r = spark.createDataFrame([(1, i, i, float(100 - i)) for i in range(1, 7)], "query_id int, id int, rank int, score double")
    d = spark.createDataFrame([(3, 1.0), (1, 0.0)], "id int, density double")
    got = {x["id"]: (x["rank"], x["score"]) for x in ranking.evidence_rerank(r, d, most=3).collect()}
    assert got[4] == (4, 96.0) and got[6] == (6, 94.0) and sorted(v[0] for v in got.values()) == [1, 2, 3, 4, 5, 6] and got[1] == (1, 0.35) and got[3] == (2, 0.35)  # a tie: the smaller id first


@pytest.mark.parametrize("limit", [1 << 20, 0])
@pytest.mark.parametrize("metric", ["cosine", "ip", "l2"])
def test_knn_equals_brute_force(spark, metric, limit):
    r = np.random.default_rng(4)
    x = r.integers(-2, 3, (60, 5)).astype(float)
    data = [(i, v.tolist()) for i, v in enumerate(x)] + [(100, None), (101, [1.0, None, 0.0, 0.0, 0.0])]
    df = spark.createDataFrame(data, "vec_id long, embedding array<double>")
    s = x @ x.T
    if metric == "cosine":
        n = np.linalg.norm(x, axis=1)
        s = s / np.maximum(np.outer(n, n), 1e-10)
    elif metric == "l2":
        s = 1 / (1 + np.linalg.norm(x[:, None] - x[None], axis=2))
    s = np.round(s, 6)
    want = sorted((i, k + 1, j) for i in range(60) for k, j in enumerate([j for j in sorted(range(60), key=lambda j: (-s[i, j], j)) if j != i][:7]))
    assert sorted((r["query_id"], r["rank"], r["key_id"]) for r in vectors.knn_join(df, df, 7, exclude_self=True, metric=metric, broadcast_bytes=limit).collect()) == want
    assert vectors.knn_join(df.limit(0), df, 3, broadcast_bytes=limit).count() == 0 and vectors.knn_join(df, df.limit(0), 3, broadcast_bytes=limit).count() == 0


def test_large_query_sets_hand_on_k_rows_a_query(spark):
    df = spark.createDataFrame([(i, np.random.default_rng(i).normal(size=8).tolist()) for i in range(600)], "vec_id long, embedding array<double>").repartition(7)
    usable = vectors._usable(df, "vec_id", "embedding")
    limit, vectors.BLOCK_ROWS = vectors.BLOCK_ROWS, 50
    try:
        found = vectors._nearest(usable, usable, 20, None, True, "cosine", None, 0)
        assert found.count() == 600 * 20 == found.distinct().count()
        flat, grouped = (rows(vectors.lsh_join(df, df, 5, 3, 4, broadcast_bytes=n)) for n in (1 << 20, 0))
        assert flat == grouped
        assert rows(vectors.knn_join(df, df, 20)) == rows(vectors.knn_join(df, df, 20, broadcast_bytes=0))
    finally:
        vectors.BLOCK_ROWS = limit


def test_what_waits_for_sorting_is_bounded():
    r, most = np.random.default_rng(1), 0
    best = vectors._Best(np.arange(500), r.normal(size=(500, 4)), 5, None, False, "l2")
    for at in range(0, 40_000, 4_000):
        best.see(r.normal(size=(4_000, 4)), np.arange(at, at + 4_000))
        most = max(most, best.waiting + len(best.row))
    assert most < vectors.WAITING_ROWS + vectors.PAIR_ROWS + 2_500 and sum(b.num_rows for b in best.batches()) == 2_500


def test_lsh_exchanges_no_pairs(spark):
    df = spark.createDataFrame([(i, [1.0, i / 1e3]) for i in range(300)], "vec_id long, embedding array<double>")  # all share their signatures
    plan = vectors.lsh_join(df, df, 3)._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan.replace("AntiJoin", "")


def test_vectors_of_odd_shape(spark):
    df = spark.createDataFrame([(1, [1.0, 0.0]), (2, [1.0])], "vec_id long, embedding array<double>")
    with pytest.raises(Exception, match="unequal"):
        vectors.knn_join(df, df, 1).collect()
    many = spark.createDataFrame([(i, (np.random.default_rng(i % 40).normal(size=8) + i / 1e4).tolist()) for i in range(200)], "vec_id long, embedding array<double>")
    flat, lsh = ({(r["query_id"], r["key_id"]) for r in f.collect()} for f in (vectors.knn_join(many, many, 5), vectors.lsh_join(many, many, 5, 8, 6)))
    assert len(flat & lsh) / len(flat) >= 0.9
    named = spark.createDataFrame([(1, "ab", [1.0, 0.0]), (2, "abc", [1.0, 0.1]), (3, "", [1.0, 0.0]), (4, "xyz", [0.9, 0.1])], "vec_id long, name string, embedding array<double>")
    assert {(r["src"], r["dst"]) for r in vectors.synonym_edges(named, text_col="name").collect()} == {(2, 1), (2, 4), (4, 1), (4, 2)}
    tokens = spark.createDataFrame([(1, 0, 2.0, 1), (1, 0, 4.0, 1), (1, 0, 9.0, 0)], "id int, pos int, value double, mask int")
    assert rows(vectors.mean_pooled(tokens, "id")) == [(1, 0, 3.0)]


def test_answer_scores_have_no_text_as_key(spark):
    a = spark.createDataFrame([(1, "b a b", "b b c"), (None, "x", "x")], "q int, predicted string, gold string")
    scored = metrics.answer_scores(a, "q")
    plan = scored._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan and plan.count("Aggregate [") == 1
    assert rows(scored.withColumn("f1", F.round("f1", 4))) == [(1, 0.0, 0.8), (None, 1.0, 1.0)]


def test_memory_search_hands_on_k_rows_a_query(spark):
    nodes = spark.createDataFrame([(i, "x a b y" if i % 7 == 0 else "xa by" if i % 5 == 0 else "b\u00a0a", None if i == 3 else 1.0 + i % 3 / 10, "active", "a b") for i in range(60)], "node int, content string, weight double, state string, tag string").repartition(2)
    q = spark.createDataFrame([(1, "a b"), (2, "x a b y"), (3, None)], "query_id int, query string")
    found = memory.search(nodes, q, 4)
    assert [(r["query_id"], r["node"], r["score"]) for r in found.orderBy("query_id", "rank").collect()] == [(1, 5, 3.6), (1, 14, 3.6), (1, 20, 3.6), (1, 35, 3.6), (2, 14, 2.4), (2, 35, 2.4), (2, 56, 2.4), (2, 7, 2.2)]
    assert "CartesianProduct" not in (plan := found._jdf.queryExecution().executedPlan().toString()) and "NestedLoop" not in plan


def test_metrics(spark):
    a = spark.createDataFrame([(1, "the County", "Rockland county"), (1, "the County", "county!"), (2, "x", "y"), (3, None, "z"), (4, "a b b", "b b c"), (5, "", "")], "q int, predicted string, gold string")
    got = {r["q"]: (r["em"], round(r["f1"], 4)) for r in metrics.answer_scores(a, "q").collect()}
    assert got == {1: (1.0, 1.0), 2: (0.0, 0.0), 3: (0.0, 0.0), 4: (0.0, 0.8), 5: (1.0, 0.0)}
    assert round(metrics.answer_scores(a.where("q = 1").limit(1), "q").first()["f1"], 4) == 0.6667
    r = spark.createDataFrame([(1, "a", 1), (1, "b", 2), (2, "c", 1)], "query_id int, id string, rank int")
    g = spark.createDataFrame([(1, "b"), (1, "b"), (1, "z"), (3, "q")], "query_id int, id string")
    assert rows(metrics.recalls(r, g, (1, 2))) == [(1, 1, 0.0), (1, 2, 0.5), (2, 1, 0.0), (2, 2, 0.0), (3, 1, 0.0), (3, 2, 0.0)]


def test_extraction(spark):
    assert openie.repaired_json('{"a": [1, 2') == '{"a": [1]}' and openie.repaired_json('{"a": "x, [", "b') == '{"a": "x, ["}' and openie.repaired_json('{"a": 1}') == '{"a": 1}' and openie.repaired_json(None) is None
    assert json.loads(openie.repaired_json('{"t": [["a", "b", "c"], ["d", "e"')) == {"t": [["a", "b", "c"], ["d"]]}
    df = spark.createDataFrame([('x {"named_entities": ["b", "a", "b"]} y', 'so {"triples": [["a", "r", "b"], ["a", "r"], ["a", "r", "b"], ["A", "r", "b"]]}'), (None, None), ("none", '{"triples": [["cut')], "ner string, re string")
    got = openie.extracted(df).collect()
    assert got[0]["extracted_entities"] == ["a", "b"] and got[0]["extracted_triples"] == [["a", "r", "b"], ["A", "r", "b"]] and got[1]["extracted_triples"] == got[2]["extracted_triples"] == []
    assert openie.phrase_stats(openie.extracted(df.limit(0))).first()["avg_ent_chars"] == 0
    said = spark.createDataFrame([('[[ ## fact_after_filter ## ]]\n{"fact": [["a", "b", "c"]]}\n\n[[ ## completed ## ]]',), ("[[ ## fact_after_filter ## ]]\noops",), (None,)], "x string")
    assert [r[0] for r in said.select(openie.filtered_facts(F.col("x"))).collect()] == [[["a", "b", "c"]], [], []]
    cand = spark.createDataFrame([(1, 1, "('paris', 'in', 'france')", 0.9), (1, 2, "('rome', 'in', 'italy')", 0.8)], "query_id int, rank int, fact string, score double")
    kept = spark.createDataFrame([(1, 0, "('Rome', 'in', 'Italy')"), (1, 1, None)], "query_id int, pos int, fact string")
    assert rows(openie.fuzzy_filter(cand, kept)) == [(1, 1, "('rome', 'in', 'italy')", 0.8)]
    assert one(spark, openie.repair_json(F.lit("[1, 2")))[0] == "[1]"


def test_memory(spark, tmp_path):
    events = spark.createDataFrame([(1, "2024-01-01 00:00:00"), (1, "2024-01-01 01:00:00"), (2, "2024-01-01 01:00:00"), (None, "2024-01-01 01:00:00"), (3, "2024-01-01 00:30:00")], "user_id long, ts string").withColumn("ts", F.col("ts").cast("timestamp"))
    got = {r["node"]: (r["frequency"], r["state"]) for r in memory.memory_states(events).collect()}
    assert got == {1: (0.5, "active"), 2: (1.0, "active"), 3: (0.5, "active")}
    assert memory.memory_states(events.limit(0)).count() == 0
    states = spark.createDataFrame([(1, "forgotten"), (2, "forgotten"), (3, "active")], "node long, state string")
    assert rows(memory.reactivated(states, events.where("user_id = 1"))) == [(1, "reactivated", 1.5), (2, "forgotten", 1.0), (3, "active", 1.0)]
    nodes = spark.createDataFrame([("a", "Likes green tea", 1.0, "active", "tea lover"), ("b", "green car", 1.0, "compressed", None), ("c", "green tea", 1.0, "forgotten", None)], "node string, content string, weight double, state string, tag string")
    q = spark.createDataFrame([(1, "green tea"), (2, None)], "query_id int, query string")
    assert [(r["node"], r["score"]) for r in memory.search(nodes, q).collect()] == [("a", 2.0), ("b", 1.5)]
    assert one(spark, memory.coefficient(F.lit(5000), F.lit(0)), memory.crowded(F.lit(9000), F.lit(1)))[0] == 0.5
    # the stream, in two runs, equals the batch
    src, out, check = (str(tmp_path / x) for x in ("src", "out", "check"))
    for part in (events.limit(2), events.subtract(events.limit(2))):
        part.coalesce(1).write.mode("append").parquet(src)
        run = memory.stream_totals(spark.readStream.schema(events.schema).parquet(src), out, check)
        run.awaitTermination(120)
    assert rows(memory.stream_latest(spark.read.parquet(out)), "node", "accesses", "first_ts", "last_ts") == rows(memory.totals(events), "node", "accesses", "first_ts", "last_ts")


def test_sources_and_prompts(spark, tmp_path):
    (tmp_path / "c.json").write_text(json.dumps([{"title": "T", "text": "x", "idx": 0}]))
    assert tables.corpus(spark, str(tmp_path / "c.json")).first()["document"] == "T\nx"
    samples = [
        {"question": "1", "answer": ["a", "b", "a"], "paragraphs": [{"title": "P", "text": "t", "is_supporting": True}, {"title": "Q", "paragraph_text": "u"}, {"title": "R", "text": "no", "is_supporting": False}], "answer_aliases": ["c"]},
        {"question": "2", "answer": "x", "supporting_facts": [["S", 0]], "context": [["S", ["one.", "two."]], ["N", ["no"]]]},
        {"question": "3", "obj": "o", "possible_answers": ["p", ""], "o_wiki_title": "", "o_aliases": None, "contexts": [{"title": "K", "text": "k", "is_supporting": True}, {"title": "L", "text": "l", "is_supporting": False}]},
        {"question": "4", "reference": "r"},
    ]
    (tmp_path / "q.json").write_text(json.dumps(samples))
    got = {r["question"]: (sorted(r["gold_docs"]), sorted(r["gold_answers"])) for r in tables.gold_answers(tables.gold_docs(tables.samples(spark, str(tmp_path / "q.json")))).collect()}
    assert got == {"1": (["P\nt", "Q\nu"], ["a", "b", "c"]), "2": (["S\none. two."], ["x"]), "3": (["K\nk"], ["o", "p"]), "4": ([], ["r"])}
    (tmp_path / "o.json").write_text(json.dumps({"docs": [{"idx": "old", "passage": "p", "extracted_entities": ["e"], "extracted_triples": [["a", "b", "c"]]}]}))
    assert tables.openie(spark, str(tmp_path / "o.json")).first()["chunk"].startswith("chunk-")
    assert prompts.as_template("a {x} {y} {z}", {"x": "q"}, {"z": 3}) == "a ${q} ${y} 3"
    p = prompts.Prompts({"qa": [("system", "be brief"), ("user", "Q: ${q} $$5")]})
    assert p.render("qa", q="why")[1]["content"] == "Q: why $5" and p.valid("qa") and p.names() == ["qa"]
    assert one(spark, prompts.chat_text(p.column("qa", q=F.lit("why"))))[0] == "<|system|>\nbe brief\n<|user|>\nQ: why $5\n<|assistant|>\n"


def test_engine(spark, tmp_path):
    e = Engine(spark, f"file://{tmp_path}/index")
    docs = ["Paris is the capital of France.", "Rome is the capital of Italy.", "Oliver Badman is a politician.", "Montebello is a part of Rockland County."]
    frame = lambda xs: spark.createDataFrame([(x,) for x in xs], "passage string")
    e.index(frame(docs)), e.index(frame(docs[:2] + [None]))
    facts, entities = rows(e.facts.load()), rows(e.entities.load(), "entity")
    assert e.chunks.count() == 4 and len(facts) == 4 and len(entities) == 8
    extra = ["Erik is a part of Rockland County.", "Paris is the capital of France!"]
    e.index(frame(extra))
    assert e.chunks.count() == 6
    e.delete(frame(extra))
    assert rows(e.facts.load()) == facts and rows(e.entities.load(), "entity") == entities and e.chunks.count() == 4
    q = spark.createDataFrame([(1, "What is the capital of Italy?"), (2, "Who is Oliver Badman?")], "query_id int, question string")
    for dense_only in (False, True):
        best = {r["query_id"]: r["id"] for r in e.retrieve(q, dense_only).where("rank = 1").collect()}
        ids = {r["chunk"]: r["passage"] for r in e.chunks.load().collect()}
        assert ids[best[1]] == docs[1] and ids[best[2]] == docs[2]
    answers = {r["query_id"]: r["answer"] for r in e.answer(q).collect()}
    assert answers == {1: docs[1], 2: docs[2]}
    recall, quality = e.evaluate(q, spark.createDataFrame([(1, docs[1]), (2, docs[2])], "query_id int, passage string"), spark.createDataFrame([(1, docs[1]), (2, "no")], "query_id int, gold string"))
    assert {r["k"]: r["recall"] for r in recall.collect()}[1] == 1.0 and quality.first()["em"] == 0.5
    assert adapters.HashEmbedder(8).encode(["", None]).sum() == 0
