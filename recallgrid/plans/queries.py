"""Registered queries and the equivalent SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from recallgrid.functions import scores, text
from recallgrid.operators import fusion, graph, metrics, openie, passages, ranking, store, vectors
from recallgrid.sources.tables import table
from recallgrid.streaming import memory

QUERIES, SQL = {}, {}


def query(sql: str | None, name: str | None = None):
    def add(f):
        QUERIES[name or f.__name__] = f
        if sql:
            SQL[name or f.__name__] = sql
        return f

    return add


def _list(words) -> str:
    return "[" + ", ".join("'" + w.replace("'", "''") + "'" for w in words) + "]"


# ---- vectors

_COS = "round(CASE WHEN {n} < 1e-10 THEN 0 ELSE list_inner_product(a.v, b.v) / {n} END, 6)".format(n="(sqrt(list_inner_product(a.v, a.v)) * sqrt(list_inner_product(b.v, b.v)))")
_VEC = "v AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings)"
_ASKED = "v WHERE vec_id % 50 = 0"


def _knn(score: str = _COS, queries: str = "v", keys: str = "v", on: str = "true", where: str = "rank <= 10") -> str:
    return f"""WITH {_VEC}, s AS (SELECT a.vec_id AS query_id, b.vec_id AS key_id, {score} AS score FROM (SELECT * FROM {queries}) a CROSS JOIN (SELECT * FROM {keys}) b WHERE {on}),
    r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, key_id) AS rank FROM s) SELECT query_id, CAST(rank AS INTEGER) AS rank, key_id, score FROM r WHERE {where}"""


def _asked(e):
    """The stated set of queries: the vectors whose id is divisible by 50."""
    return e.where("vec_id % 50 = 0")


@query(_knn())
def dense_topk(spark, d):
    e = table(spark, d, "embeddings")
    return vectors.knn_join(e, e, 10)


@query(_knn(on="a.vec_id <> b.vec_id", where="rank <= 101"))
def knn_self_join(spark, d):
    e = table(spark, d, "embeddings")
    return vectors.knn_join(e, e, 101, exclude_self=True)


@query("SELECT query_id AS src, key_id AS dst, score AS weight FROM (" + _knn(on="a.vec_id <> b.vec_id", where="rank <= 101 AND score >= 0.8") + ")")
def synonym_edges(spark, d):
    return vectors.synonym_edges(table(spark, d, "embeddings"))


@query(_knn(queries=_ASKED, keys="v WHERE label = 3"))
def filtered_topk(spark, d):
    e = table(spark, d, "embeddings")
    return vectors.search(_asked(e), e, 10, {"label": 3})


@query(_knn("round(1 / (1 + sqrt(list_sum(list_transform(list_zip(a.v, b.v), lambda z: (z[1] - z[2]) * (z[1] - z[2]))))), 6)", _ASKED))
def l2_topk(spark, d):
    e = table(spark, d, "embeddings")
    return vectors.knn_join(_asked(e), e, 10, metric="l2")


@query(_knn("round(list_inner_product(a.v, b.v), 6)", _ASKED))
def two_step_topk(spark, d):
    e = table(spark, d, "embeddings")
    return vectors.two_step_join(_asked(e), e, 10)


_PLANE = "(((t * 7919 + b * 104729 + w * 1299709 + 12345) * 48271 % 2147483647 % 10007) / 5003.0 - 1.0)"


@query(f"""WITH {_VEC}, p AS (SELECT t, b, list(CAST({_PLANE} AS DOUBLE) ORDER BY w) AS plane FROM range(4) x(t), range(6) y(b), range((SELECT max(len(v)) FROM v)) z(w) GROUP BY t, b),
    g AS (SELECT vec_id, t, sum(CASE WHEN list_inner_product(v, plane) > 0 THEN CAST(1 AS BIGINT) << b ELSE 0 END) AS sig FROM v CROSS JOIN p GROUP BY vec_id, t),
    c AS (SELECT DISTINCT a.vec_id AS query_id, b.vec_id AS key_id FROM g a JOIN g b USING (t, sig) WHERE a.vec_id % 50 = 0),
    s AS (SELECT query_id, key_id, {_COS} AS score FROM c JOIN v a ON a.vec_id = query_id JOIN v b ON b.vec_id = key_id),
    r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, key_id) AS rank FROM s) SELECT query_id, CAST(rank AS INTEGER) AS rank, key_id, score FROM r WHERE rank <= 10""")
def lsh_topk(spark, d):
    e = table(spark, d, "embeddings")
    return vectors.lsh_join(_asked(e), e, 10, tables=4, bits=6)


@query(f"WITH {_VEC} SELECT vec_id, CAST(unnest(generate_series(0, len(v) - 1)) AS INTEGER) AS pos, unnest(list_transform(v, lambda x: round(x / sqrt(list_inner_product(v, v)), 7))) AS x FROM v")
def l2_normalize(spark, d):
    return table(spark, d, "embeddings").select("vec_id", F.posexplode(F.transform(vectors.l2_normalised(F.col("embedding")), lambda x: F.round(x, 7))).alias("pos", "x"))


@query(f"WITH {_VEC}, m AS (SELECT vec_id, label, round(v[1], 6) AS x FROM v) SELECT vec_id, label, round(CASE WHEN max(x) OVER p - min(x) OVER p < 1e-10 THEN 1 ELSE (x - min(x) OVER p) / (max(x) OVER p - min(x) OVER p) END, 6) AS scaled FROM m WINDOW p AS (PARTITION BY label)")
def minmax_scores(spark, d):
    m = table(spark, d, "embeddings").select("vec_id", "label", F.round(F.col("embedding")[0].cast("double"), 6).alias("x"))
    return scores.minmax_by(m, "x", "s", "label").select("vec_id", "label", F.round("s", 6).alias("scaled"))


@query("SELECT a.user_id, round(coalesce(sum(a.v * b.v), 0), 4) AS dot FROM (SELECT user_id, event_type, sum(value) AS v FROM events WHERE event_id % 2 = 0 GROUP BY ALL) a FULL JOIN (SELECT user_id, event_type, sum(value) AS v FROM events WHERE event_id % 2 = 1 GROUP BY ALL) b USING (user_id, event_type) WHERE a.user_id IN (SELECT user_id FROM events WHERE event_id % 2 = 1) GROUP BY a.user_id")
def sparse_dot(spark, d):
    e = table(spark, d, "events").select("user_id", F.col("event_type").alias("pos"), "value", (F.col("event_id") % 2).alias("half"))  # the two vectors of a user
    return vectors.sparse_dot(e.where("half = 0"), e.where("half = 1"), "user_id").withColumn("dot", F.round("dot", 4))


# ---- texts


@query("SELECT doc_id, trim(regexp_replace(lower(text), '[^a-z0-9 ]', ' ', 'g'), ' ') AS plain, 'chunk-' || md5(text) AS chunk_id FROM documents")
def text_processing(spark, d):
    return table(spark, d, "documents").select("doc_id", text.plain(F.col("text")).alias("plain"), text.content_id(F.col("text"), "chunk-").alias("chunk_id"))


# letters beyond ASCII are made underscores, which are word characters, and other signs beyond it semicolons, as \b knows ASCII only there
_DENSITY = f"""c AS (SELECT doc_id, source, n_chars, text, length(text) AS n, regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}_]+') AS words, regexp_replace(regexp_replace(text, '[^\\x00-\\x7F\\p{{L}}\\p{{N}}]', ';', 'g'), '[^\\x00-\\x7F]', '_', 'g') AS t FROM documents),
    w AS (SELECT *, len(regexp_extract_all(t, '\\b[A-Z][a-z]+(?:\\s+[A-Z][a-z]+)*\\b')) + len(regexp_extract_all(t, '\\b\\d+(?:\\.\\d+)?(?:\\s*(?:km|m|kg))?\\b')) + len(regexp_extract_all(t, '\\b[A-Z]{{2,}}(?:\\s+[A-Z]{{2,}})*\\b')) AS ents,
      len(regexp_extract_all(lower(t), '\\b(?:{"|".join(text.RELATION_WORDS)})\\b')) AS facts FROM c),
    m AS (SELECT doc_id, source, n_chars, ents, facts, CASE WHEN n = 0 THEN 0 WHEN n <= 350 THEN n / 350.0 ELSE greatest(0.5, 1 - 0.5 * (n - 350) / 650.0) END AS len_score,
      CASE WHEN len(words) = 0 THEN 0 ELSE least(1.0, CAST(0.6 AS DOUBLE) * len(list_filter(words, lambda x: NOT list_contains({_list(text.DENSITY_STOP)}, x))) / len(words) + CAST(0.4 AS DOUBLE) * len(list_distinct(words)) / len(words)) END AS rich FROM w),
    t AS (SELECT *, CAST(0.3 * least(1.0, ln(1 + ents) / 3) + 0.3 * least(1.0, ln(1 + facts) / 2.5) + 0.2 * len_score + 0.2 * rich AS DOUBLE) AS density FROM m)"""


@query(f"WITH {_DENSITY} SELECT doc_id, CAST(ents AS INTEGER) AS entities, CAST(facts AS INTEGER) AS facts, round(CAST(len_score AS DOUBLE), 6) AS length_score, round(CAST(rich AS DOUBLE), 6) AS richness, round(density, 6) AS density, CASE WHEN density < 0.3 THEN 'low' WHEN density > 0.7 THEN 'high' ELSE 'medium' END AS band FROM t")
def density_score(spark, d):
    r = lambda c: F.round(c, 6).alias(c)
    return text.with_density(table(spark, d, "documents")).select("doc_id", "entities", "facts", r("length_score"), r("richness"), r("density"), text.density_band(F.col("density")).alias("band"))


@query(f"""WITH {_DENSITY}, r AS (SELECT source AS query_id, doc_id AS id, density, CAST(n_chars AS DOUBLE) AS score, row_number() OVER (PARTITION BY source ORDER BY n_chars DESC, doc_id) AS rank FROM t),
    h AS (SELECT *, CASE WHEN max(score) OVER p - min(score) OVER p < 1e-10 THEN 1 ELSE (score - min(score) OVER p) / (max(score) OVER p - min(score) OVER p) END AS s FROM r WHERE rank <= 100 WINDOW p AS (PARTITION BY query_id)),
    e AS (SELECT query_id, id, 0.3 * s * density + 0.7 * (0.5 * s + 0.5 * density) AS score FROM h)
    SELECT query_id, id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS INTEGER) AS rank, round(score, 6) AS score FROM e UNION ALL SELECT query_id, id, CAST(rank AS INTEGER), score FROM r WHERE rank > 100""")
def evidence_rank(spark, d):
    docs = text.with_density(table(spark, d, "documents")).select(F.col("source").alias("query_id"), F.col("doc_id").alias("id"), F.col("n_chars").cast("double").alias("score"), "density")
    return ranking.evidence_rerank(ranking.ranked(docs).drop("density"), docs.select("id", "density")).withColumn("score", F.round("score", 6))


@query("""WITH p AS (SELECT split_part(text, chr(10), 1) AS head, text, row_number() OVER (PARTITION BY split_part(text, chr(10), 1) ORDER BY doc_id) AS i, doc_id FROM documents WHERE text IS NOT NULL)
    SELECT head, count(*) AS n, 'Wikipedia Title: ' || string_agg(CASE WHEN i = 1 THEN text ELSE trim(substr(text, length(head) + 1), chr(10)) END, chr(10) ORDER BY doc_id) AS merged FROM p GROUP BY head""")
def merge_first_line(spark, d):
    return passages.merged_by_title(table(spark, d, "documents"))


_Q = "q AS (SELECT item_id, text, list_filter(regexp_split_to_array(trim(lower(text)), '\\s+'), lambda x: x <> '') AS w, list_filter(regexp_split_to_array(trim(text), '\\s+'), lambda x: x <> '') AS u FROM benchmark), k AS (SELECT *, list_filter(w, lambda x: NOT list_contains(" + _list(text.QUERY_STOP) + ", x)) AS kept FROM q)"
_REWRITTEN = "CASE WHEN len(kept) * 2 >= len(w) THEN array_to_string(kept, ' ') ELSE text END"
_EXPANDED = "CASE WHEN len(u) > 3 THEN [u[1], u[1] || ' ' || u[2], u[1] || ' ' || u[2] || ' ' || u[3]] ELSE [] END"


def _decomposed(c: str) -> str:
    parts = lambda by: f"list_slice(list_filter(list_transform(string_split(lower({c}), '{by}'), lambda x: trim(x, ' ')), lambda x: x <> ''), 1, 3)"
    return "CASE " + " ".join(f"WHEN contains(lower({c}), '{by}') THEN {parts(by)}" for by in text.CONJUNCTIONS) + " ELSE [] END"


@query(f"WITH {_Q} SELECT item_id, {_REWRITTEN} AS rewritten, array_to_string({_EXPANDED}, '|') AS expanded FROM k")
def query_rewrite(spark, d):
    c = F.col("text")
    return table(spark, d, "benchmark").select("item_id", text.rewritten(c).alias("rewritten"), F.array_join(text.expanded(c), "|").alias("expanded"))


@query(f"SELECT conv_id, turn, array_to_string({_decomposed('text')}, '|') AS parts FROM conversations")
def query_decompose(spark, d):
    return table(spark, d, "conversations").select("conv_id", "turn", F.array_join(text.decomposed(F.col("text")), "|").alias("parts"))


@query(f"WITH {_Q}, o AS (SELECT item_id, text, list_concat(CASE WHEN {_REWRITTEN} <> text THEN [{_REWRITTEN}] ELSE [] END, {_EXPANDED}, {_decomposed('text')}) AS every FROM k) SELECT item_id, array_to_string(CASE WHEN len(every) > 0 THEN every ELSE [text] END, '|') AS queries FROM o")
def query_optimise(spark, d):
    return table(spark, d, "benchmark").select("item_id", F.array_join(text.optimised(F.col("text")), "|").alias("queries"))


@query("""WITH p AS (SELECT conv_id, list(text ORDER BY turn) FILTER (WHERE role <> 'user') AS said, list(text ORDER BY turn) FILTER (WHERE role = 'user') AS asked FROM conversations GROUP BY conv_id)
    SELECT conv_id, coalesce(array_to_string(list_transform(list_slice(said, 1, 5), lambda x: 'Wikipedia Title: ' || x || chr(10) || chr(10)), ''), '') || 'Question: ' || asked[1] || chr(10) || 'Thought: ' AS prompt FROM p WHERE len(asked) > 0""")
def qa_prompt(spark, d):
    c = table(spark, d, "conversations").select("conv_id", "role", F.struct("turn", "text").alias("x"))
    said = F.transform(F.sort_array(F.collect_list(F.when(F.col("role") != "user", F.col("x")))), lambda x: x["text"])
    both = c.groupBy("conv_id").agg(said.alias("said"), F.min(F.when(F.col("role") == "user", F.col("x")))["text"].alias("asked")).where("asked is not null")  # the turns of one conversation
    return both.select("conv_id", text.qa_prompt(F.col("asked"), F.col("said")).alias("prompt"))


@query("SELECT conv_id, turn, trim(text, ' ') AS answer, CASE WHEN length(text) > 50 THEN left(text, 50) || '...' ELSE text END AS summary, CASE WHEN text = '' THEN ' ' ELSE replace(text, chr(10), ' ') END AS line, sha256('{\"conv_id\":' || conv_id || ',\"turn\":' || turn || '}') AS cache_key FROM conversations WHERE NOT contains(text, 'Answer:')")
def answer_parse(spark, d):
    c = table(spark, d, "conversations")
    said = F.concat(F.lit("Thought: so. Answer:"), F.lit(" "), F.col("text"), F.lit(" Answer: no"))
    return c.where(~F.contains("text", F.lit("Answer:"))).select("conv_id", "turn", text.parsed_answer(said).alias("answer"), text.summary(F.col("text")).alias("summary"), text.embedding_text(F.col("text")).alias("line"), text.cache_key(F.col("conv_id"), F.col("turn")).alias("cache_key"))


# ---- stores


@query("SELECT md5(text) AS id, min(text) AS text FROM (SELECT text FROM documents UNION ALL SELECT text FROM benchmark) GROUP BY md5(text)")
def insert_if_absent(spark, d):
    docs, more = (table(spark, d, n).select(F.md5("text").alias("id"), "text") for n in ("documents", "benchmark"))
    return store.insert_if_absent(store.insert_if_absent(docs.limit(0), docs, "id"), more, "id")


@query("SELECT DISTINCT md5(text) AS id FROM benchmark WHERE md5(text) NOT IN (SELECT md5(text) FROM documents)")
def missing_ids(spark, d):
    docs, more = (table(spark, d, n).select(F.md5("text").alias("id")) for n in ("documents", "benchmark"))
    return store.missing(docs, more, "id")


@query("SELECT doc_id, lang, 'new' AS origin FROM (SELECT d.doc_id, d.lang FROM documents d JOIN labels l USING (doc_id) GROUP BY ALL) UNION ALL SELECT doc_id, lang, 'old' FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def upsert_docs(spark, d):
    docs = table(spark, d, "documents").select("doc_id", "lang")
    new = docs.join(table(spark, d, "labels").select("doc_id"), "doc_id", "left_semi").withColumn("origin", F.lit("new"))
    return store.upsert(docs.withColumn("origin", F.lit("old")), new, "doc_id")


@query("SELECT d.doc_id, d.lang FROM documents d WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id)")
def delete_docs(spark, d):
    return store.delete(table(spark, d, "documents").select("doc_id", "lang"), table(spark, d, "labels"), "doc_id")


@query("SELECT d.doc_id, d.n_chars, l.doc_id IS NOT NULL AS found, CAST(coalesce(l.quality, -1) AS INTEGER) AS quality FROM documents d LEFT JOIN labels l USING (doc_id)")
def store_lookup(spark, d):
    found = store.lookup(table(spark, d, "labels").select("doc_id", "quality"), table(spark, d, "documents"), "doc_id", order="n_chars")
    return found.withColumn("quality", F.coalesce("quality", F.lit(-1)).cast("int"))


@query("SELECT text, row_number() OVER (ORDER BY text) - 1 AS code FROM (SELECT DISTINCT md5(text) AS text FROM documents WHERE text IS NOT NULL)")
def index_mapping(spark, d):
    return store.distinct_ids(table(spark, d, "documents").select(F.md5("text").alias("text")), "text")


# ---- facts and graph


def facts(spark, d):
    """Facts from the star schema: customers and suppliers in nations, nations in regions; the chunk is the row."""
    t = lambda n: table(spark, d, n)
    name = lambda p, c: F.concat(F.lit(p), F.col(c).cast("string"))
    rows = [("customer", "c", "c_custkey", "n", "c_nationkey"), ("supplier", "s", "s_suppkey", "n", "s_nationkey"), ("nation", "n", "n_nationkey", "r", "n_regionkey")]
    parts = [t(n).select(name(f"chunk-{p}", k).alias("chunk"), name(p, k).alias("s"), F.lit("in").alias("p"), name(q, o).alias("o"), F.col(k).cast("long").alias("number")) for n, p, k, q, o in rows]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


_FACTS = """f AS (SELECT 'chunk-c' || c_custkey AS chunk, 'c' || c_custkey AS s, 'in' AS p, 'n' || c_nationkey AS o, c_custkey AS number FROM customer UNION ALL SELECT 'chunk-s' || s_suppkey, 's' || s_suppkey, 'in', 'n' || s_nationkey, s_suppkey FROM supplier UNION ALL SELECT 'chunk-n' || n_nationkey, 'n' || n_nationkey, 'in', 'r' || n_regionkey, n_nationkey FROM nation),
    fe AS (SELECT src, dst, CAST(count(*) AS DOUBLE) AS weight FROM (SELECT s AS src, o AS dst FROM f UNION ALL SELECT o, s FROM f) GROUP BY ALL),
    pe AS (SELECT DISTINCT chunk, unnest([s, o]) AS entity FROM f),
    ge AS (SELECT src, dst, sum(weight) AS weight FROM (SELECT * FROM fe UNION ALL SELECT chunk, entity, 1.0 FROM pe) GROUP BY ALL),
    nd AS (SELECT DISTINCT entity AS name, 'entity' AS kind FROM pe UNION ALL SELECT DISTINCT chunk, 'chunk' FROM f)"""
_STEPS = """tw AS (SELECT src, dst, sum(weight) AS weight FROM (SELECT src, dst, weight FROM ge UNION ALL SELECT dst, src, weight FROM ge WHERE src <> dst) GROUP BY ALL),
    st AS MATERIALIZED (SELECT src, dst, weight / sum(weight) OVER (PARTITION BY src) AS p FROM tw)"""


def _walk(reset: str, n: int = 20) -> str:
    """x0 ... xn over (query_id, node, r)."""
    steps = [f"x0 AS MATERIALIZED (SELECT query_id, node, r AS score FROM {reset})"]
    steps += [f"x{i} AS MATERIALIZED (SELECT query_id, node, sum(score) AS score FROM (SELECT query_id, dst AS node, score * p * 0.5 AS score FROM x{i - 1} JOIN st ON node = src UNION ALL SELECT query_id, node, r * 0.5 FROM {reset}) GROUP BY ALL)" for i in range(1, n + 1)]
    return ", ".join(steps)


@query(f"WITH {_FACTS} SELECT src, dst, weight FROM ge")
def graph_edges(spark, d):
    return graph.graph_edges(facts(spark, d))


@query(f"WITH {_FACTS} SELECT name, kind FROM nd")
def graph_nodes(spark, d):
    return graph.nodes(facts(spark, d))


@query(f"WITH {_FACTS} SELECT entity, count(*) AS chunks FROM pe GROUP BY entity")
def mentions(spark, d):
    return graph.mentions(facts(spark, d)).groupBy("entity").agg(F.count("*").alias("chunks"))


@query(f"WITH {_FACTS} SELECT chunk, s, o FROM f WHERE chunk NOT IN (SELECT name FROM nd WHERE name LIKE 'chunk-c%')")
def new_facts(spark, d):
    f = facts(spark, d)
    return graph.new_facts(f, graph.nodes(f).where("name like 'chunk-c%'")).select("chunk", "s", "o")


@query(f"WITH {_FACTS}, ok AS (SELECT name FROM nd WHERE name NOT LIKE 's%') SELECT src, dst, weight FROM ge WHERE src <> dst AND src IN (SELECT name FROM ok) AND dst IN (SELECT name FROM ok)")
def valid_edges(spark, d):
    f = facts(spark, d)
    return graph.valid_edges(graph.graph_edges(f), graph.nodes(f).where("name not like 's%'"))


@query(f"WITH {_FACTS}, g AS (SELECT src, count(*) AS degree FROM (SELECT * FROM ge WHERE weight >= 1.0) GROUP BY src) SELECT src AS node, degree, round(degree / (sum(degree) OVER () + 1e-8), 9) AS importance FROM g")
def degree_importance(spark, d):
    return graph.degree_importance(graph.strong_edges(graph.graph_edges(facts(spark, d)), 1.0)).withColumn("importance", F.round("importance", 9))


@query(f"WITH {_FACTS} SELECT s, p, o, count(DISTINCT chunk) AS chunks FROM f GROUP BY ALL")
def fact_chunks(spark, d):
    return graph.fact_chunks(facts(spark, d)).groupBy("s", "p", "o").agg(F.count("*").alias("chunks"))


@query(f"""WITH {_FACTS} SELECT (SELECT count(DISTINCT entity) FROM pe) AS phrase_nodes, (SELECT count(DISTINCT chunk) FROM f) AS passage_nodes, (SELECT count(*) FROM (SELECT DISTINCT s, p, o FROM f)) AS extracted_triples, (SELECT count(*) FROM pe) AS passage_triples,
    (SELECT count(*) FROM ge) AS total_triples, (SELECT count(*) FROM nd) AS total_nodes, (SELECT count(*) FROM ge) - (SELECT count(*) FROM (SELECT DISTINCT s, p, o FROM f)) - (SELECT count(*) FROM pe) AS synonym_triples""")
def graph_info(spark, d):
    return graph.graph_info(facts(spark, d))


@query(f"WITH {_FACTS}, {_STEPS}, r0 AS (SELECT 0 AS query_id, 'r' || r_regionkey AS node, 1.0 / count(*) OVER () AS r FROM region), {_walk('r0')} SELECT node, round(CAST(score AS DOUBLE), 8) AS score FROM x20")
def ppr_20(spark, d):
    reset = table(spark, d, "region").select(F.lit(0).alias("query_id"), F.concat(F.lit("r"), F.col("r_regionkey").cast("string")).alias("node"), F.lit(1.0).alias("r"))
    return graph.ppr(graph.graph_edges(facts(spark, d)), reset).select("node", F.round("score", 8).alias("score"))


@query(f"""WITH {_FACTS}, {_STEPS}, r0 AS (SELECT n_regionkey AS query_id, 'n' || n_nationkey AS node, 1.0 / count(*) OVER (PARTITION BY n_regionkey) AS r FROM nation), {_walk('r0')},
    q AS (SELECT query_id, node AS id, round(CAST(score AS DOUBLE), 8) AS score FROM x20 WHERE node IN (SELECT chunk FROM f)) SELECT query_id, id, score, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS INTEGER) AS rank FROM q""")
def ppr_passages(spark, d):
    f = facts(spark, d)
    reset = table(spark, d, "nation").select(F.col("n_regionkey").alias("query_id"), F.concat(F.lit("n"), F.col("n_nationkey").cast("string")).alias("node"), F.lit(3.0).alias("r"))
    found = graph.ppr(graph.graph_edges(f), reset).join(f.select(F.col("chunk").alias("node")).distinct(), "node", "left_semi")
    return ranking.ranked(found.select("query_id", F.col("node").alias("id"), F.round("score", 8).alias("score")))


# every fact and its chunk have a vector of the table: that of number * 7 modulo their count
_AT = "number * 7 % (SELECT count(*) FROM embeddings)"
_SEARCH = f"""{_FACTS}, {_STEPS}, {_VEC}, q AS (SELECT vec_id AS query_id, v FROM v WHERE vec_id % 50 = 0),
    sc AS (SELECT query_id, vec_id, {_COS.replace('a.v', 'q.v').replace('b.v', 'v.v')} AS score FROM q CROSS JOIN v),
    fs AS (SELECT query_id, s, p, o, s || '|' || p || '|' || o AS id, chunk, score FROM f JOIN sc ON vec_id = {_AT}),
    fm AS (SELECT *, CASE WHEN max(score) OVER w - min(score) OVER w < 1e-10 THEN 1 ELSE (score - min(score) OVER w) / (max(score) OVER w - min(score) OVER w) END AS sim FROM fs WINDOW w AS (PARTITION BY query_id)),
    tf AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY sim DESC, id) AS rank FROM fm) WHERE rank <= 5),
    av AS (SELECT query_id, avg(sim) AS mean, least(0.5, greatest(0.1, 0.2 + 0.3 * (0.5 - avg(sim)))) AS share FROM tf GROUP BY query_id),
    mc AS (SELECT entity, count(*) AS chunks FROM pe GROUP BY entity),
    ph AS (SELECT query_id, node, r FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY r DESC, node) AS rank FROM (SELECT query_id, entity AS node, avg(sim / chunks) AS r FROM (SELECT query_id, unnest([s, o]) AS entity, sim FROM tf) JOIN mc USING (entity) GROUP BY ALL)) WHERE rank <= 5),
    rs AS (SELECT query_id, node, r FROM ph UNION ALL SELECT query_id, chunk, sim * share FROM fm JOIN av USING (query_id)),
    r0 AS MATERIALIZED (SELECT query_id, node, r / sum(r) OVER (PARTITION BY query_id) AS r FROM (SELECT query_id, node, sum(r) AS r FROM rs GROUP BY ALL) WHERE r > 0)"""


@query(f"""WITH {_SEARCH}, {_walk('r0')}, dn AS (SELECT chunk AS id, (number % 10) / CAST(10 AS DOUBLE) AS density FROM f),
    rk AS (SELECT query_id, id, score, density, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM (SELECT query_id, node AS id, round(score, 9) AS score FROM x20) JOIN dn USING (id)),
    hd AS (SELECT *, CASE WHEN max(score) OVER w - min(score) OVER w < 1e-10 THEN 1 ELSE (score - min(score) OVER w) / (max(score) OVER w - min(score) OVER w) END AS s FROM rk WHERE rank <= 100 WINDOW w AS (PARTITION BY query_id)),
    ev AS (SELECT query_id, id, 0.3 * s * density + 0.7 * (0.5 * s + 0.5 * density) AS score FROM hd)
    SELECT query_id, id, round(score, 5) AS score, 'graph' AS path FROM ev UNION ALL SELECT query_id, id, round(score, 5), 'graph' FROM rk WHERE rank > 100""")
def graph_search(spark, d):
    f, e = facts(spark, d), table(spark, d, "embeddings")
    n = F.broadcast(e.agg(F.count("*").alias("n")))  # one row
    f = f.crossJoin(n).withColumn("vec_id", F.col("number") * 7 % F.col("n"))
    passages = f.select(F.col("chunk").alias("id"), "vec_id", ((F.col("number") % 10) / 10).alias("density"))
    found = graph.graph_search_by_vectors(f.select("chunk", "s", "p", "o", "vec_id"), passages, graph.graph_edges(f), e, _asked(e))
    return found.select("query_id", "id", F.round("score", 5).alias("score"), "path")


@query(f"""WITH {_FACTS}, g AS (SELECT n_nationkey FROM nation WHERE n_nationkey < 10), m AS (SELECT *, chunk IN (SELECT 'chunk-n' || n_nationkey FROM g) OR chunk IN (SELECT 'chunk-c' || c_custkey FROM customer JOIN g ON c_nationkey = n_nationkey) AS gone FROM f),
    e AS (SELECT entity AS id FROM (SELECT unnest([s, o]) AS entity, gone FROM m) GROUP BY entity HAVING bool_and(gone)), c AS (SELECT DISTINCT chunk AS id FROM m WHERE gone)
    SELECT 'chunk' AS kind, id FROM c UNION ALL SELECT 'fact', s || '|' || p || '|' || o FROM m GROUP BY s, p, o HAVING bool_and(gone) UNION ALL SELECT 'entity', id FROM e UNION ALL SELECT 'vertex', id FROM e UNION ALL SELECT 'vertex', id FROM c""")
def cascade_delete(spark, d):
    name = lambda p, c: F.concat(F.lit(p), F.col(c).cast("string")).alias("chunk")
    gone = table(spark, d, "nation").where("n_nationkey < 10").select(name("chunk-n", "n_nationkey"))
    more = table(spark, d, "customer").where("c_nationkey < 10").select(name("chunk-c", "c_custkey"))
    return store.cascade_delete(facts(spark, d), gone.unionByName(more))


# ---- fusion

_TWO = """a AS (SELECT lang AS query_id, doc_id AS id, CAST(n_chars AS DOUBLE) AS score, row_number() OVER (PARTITION BY lang ORDER BY n_chars DESC, doc_id) - 1 AS rank, count(*) OVER (PARTITION BY lang) AS n FROM documents),
    b AS (SELECT lang AS query_id, doc_id AS id, CAST(quality AS DOUBLE) AS score, row_number() OVER (PARTITION BY lang ORDER BY quality DESC, doc_id) - 1 AS rank, count(*) OVER (PARTITION BY lang) AS n FROM documents JOIN labels USING (doc_id))"""


def _two(spark, d):
    docs = table(spark, d, "documents").select(F.col("lang").alias("query_id"), F.col("doc_id").alias("id"), F.col("n_chars").cast("double").alias("score"))
    return docs, docs.join(table(spark, d, "labels").withColumnRenamed("doc_id", "id"), "id").select("query_id", "id", F.col("quality").cast("double").alias("score"))


def _fused(method, a, b):
    @query(f"WITH {_TWO} SELECT query_id, id, round(CAST(coalesce({a}, 0) + coalesce({b}, 0) AS DOUBLE), 6) AS score FROM a FULL JOIN b USING (query_id, id)", f"fuse_{method}")
    def f(spark, d):
        return fusion.fuse(*_two(spark, d), method).withColumn("score", F.round("score", 6))


_fused("weighted", "0.5 * a.score", "0.5 * b.score")
_fused("rrf", "0.5 / (a.rank + 1)", "0.5 / (b.rank + 1)")
_fused("borda", "0.5 * (a.n + coalesce(b.n, max(b.n) OVER (PARTITION BY query_id), 0) - a.rank)", "0.5 * (b.n + coalesce(a.n, max(a.n) OVER (PARTITION BY query_id), 0) - b.rank)")

# two rankings a source: by length, and by length of the text without blanks; the second's first place leads by far where the source's number is even
_LISTS = """a AS (SELECT source AS query_id, doc_id AS id, CAST(n_chars AS DOUBLE) AS score FROM documents),
    b AS (SELECT source AS query_id, doc_id AS id, CASE WHEN row_number() OVER (PARTITION BY source ORDER BY doc_id) = 1 AND length(source) % 2 = 0 THEN 1e9 ELSE CAST(doc_id % 97 AS DOUBLE) END AS score FROM documents),
    g AS (SELECT query_id, 'a' AS l, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank, score FROM a UNION ALL SELECT query_id, 'b', row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id), score FROM b),
    p AS (SELECT query_id, l, max(score) FILTER (WHERE rank = 1) AS s0, max(score) FILTER (WHERE rank = 2) AS s1 FROM g GROUP BY ALL),
    cf AS (SELECT query_id, l, coalesce(least(1.0, greatest(0.0, 0.5 + 0.5 * (s0 - s1) / (s0 + 1e-8))), 0.5) AS c FROM p),
    k AS (SELECT query_id, max(c) FILTER (WHERE l = 'a') AS ca, max(c) FILTER (WHERE l = 'b') AS cb FROM cf GROUP BY query_id),
    u AS (SELECT *, greatest(0.5 * ca / (ca + cb), 0.1) AS ua, greatest(0.5 * cb / (ca + cb), 0.1) AS ub FROM k),
    w AS (SELECT *, CASE WHEN ca + cb < 1e-8 THEN 0.5 ELSE ua / (ua + ub) END AS wa, CASE WHEN ca + cb < 1e-8 THEN 0.5 ELSE ub / (ua + ub) END AS wb, CASE WHEN greatest(ca, cb) > 0.95 THEN CASE WHEN ca > cb THEN 'a' ELSE 'b' END ELSE 'fused' END AS path FROM u)"""


def _lists(spark, d):
    docs = table(spark, d, "documents").select(F.col("source").alias("query_id"), F.col("doc_id").alias("id"), F.col("n_chars").cast("double").alias("score"))
    first = docs.groupBy("query_id").agg(F.min("id").alias("id")).withColumn("lead", F.length("query_id") % 2 == 0)
    other = docs.drop("score").join(first, ["query_id", "id"], "left").select("query_id", "id", F.when(F.col("lead"), 1e9).otherwise((F.col("id") % 97).cast("double")).alias("score"))
    return docs, other


@query(f"WITH {_LISTS} SELECT query_id, id, round(CASE path WHEN 'a' THEN a.score WHEN 'b' THEN b.score ELSE wa * a.score + wb * b.score END, 5) AS score, path FROM a JOIN b USING (query_id, id) JOIN w USING (query_id)")
def fuse_adaptive(spark, d):
    return fusion.fuse_adaptive(*_lists(spark, d)).withColumn("score", F.round("score", 5))


@query(f"WITH {_LISTS} SELECT query_id, round(ca, 6) AS ca, round(cb, 6) AS cb, round(wa, 6) AS wa, round(wb, 6) AS wb FROM w")
def fusion_history(spark, d):
    return fusion.confidences(*_lists(spark, d)).select("query_id", *(F.round(c, 6).alias(c) for c in ("ca", "cb", "wa", "wb")))


_SCALED = "CASE WHEN max({0}.score) OVER p - min({0}.score) OVER p < 1e-10 THEN 1 ELSE ({0}.score - min({0}.score) OVER p) / (max({0}.score) OVER p - min({0}.score) OVER p) END"


@query(f"WITH {_LISTS} SELECT query_id, id, round(0.2 * {_SCALED.format('a')} + 0.8 * {_SCALED.format('b')}, 6) AS score FROM a JOIN b USING (query_id, id) WINDOW p AS (PARTITION BY query_id)")
def fuse_dense_graph(spark, d):
    return fusion.fuse_dense_graph(*_lists(spark, d)).withColumn("score", F.round("score", 6))


@query(f"WITH {_VEC} SELECT vec_id, round(0.3 * v[1] * v[2] + 0.7 * (0.5 * v[1] + 0.5 * v[2]), 6) AS product, round(0.6 * v[1] + 0.4 * v[2], 6) AS mean, round(least(0.5, greatest(0.1, 0.2 + 0.3 * (0.5 - v[1]) + 0.2 * (0.5 - v[2]) + 0.1 * (0.5 - v[3]))), 6) AS share, label = 0 OR v[1] < 0.4 OR v[2] < 0.1 AS fallback, CASE WHEN v[1] < 0 THEN 0 ELSE v[1] END AS guarded, round(1 / (1 + abs(v[1])), 6) AS near FROM v")
def score_arithmetic(spark, d):
    v = [F.col("embedding")[i].cast("double") for i in range(3)]
    r = lambda c, n: F.round(c, 6).alias(n)
    return table(spark, d, "embeddings").select("vec_id", r(scores.multiplicative(v[0], v[1]), "product"), r(scores.weighted(v[0], v[1], 0.6, 0.4), "mean"), r(scores.adaptive_weight(*v), "share"), scores.needs_fallback(F.col("label"), v[0], v[1]).alias("fallback"), scores.guarded(v[0]).alias("guarded"), r(scores.from_distance(F.abs(v[0]), "l2"), "near"))


@query("SELECT event_type, round(sum(value * (1 + user_id % 3)) / sum(1 + user_id % 3), 6) AS mean FROM events WHERE user_id IS NOT NULL AND value IS NOT NULL GROUP BY event_type")
def weighted_average(spark, d):
    return table(spark, d, "events").groupBy("event_type").agg(F.round(scores.weighted_mean(F.col("value"), 1 + F.col("user_id") % 3), 6).alias("mean"))


@query("WITH r AS (SELECT source AS query_id, doc_id, CAST(n_chars AS DOUBLE) AS score, row_number() OVER (PARTITION BY source ORDER BY n_chars DESC, doc_id) AS rank FROM documents) SELECT query_id, max(score) FILTER (WHERE rank = 1) AS first, max(score) FILTER (WHERE rank = 2) AS second, max(score) FILTER (WHERE rank = 1) - max(score) FILTER (WHERE rank = 2) AS gap FROM r GROUP BY query_id")
def score_gap(spark, d):
    return ranking.score_gap(_lists(spark, d)[0])


@query("SELECT doc_id AS id, CAST(n_chars AS DOUBLE) AS score FROM documents ORDER BY n_chars DESC, doc_id LIMIT 25")
def top_scores(spark, d):
    return ranking.top(_lists(spark, d)[0].select("id", "score"), 25)


# ---- metrics

_RANKED = "r AS (SELECT source AS query_id, doc_id AS id, row_number() OVER (PARTITION BY source ORDER BY n_chars DESC, doc_id) AS rank FROM documents), g AS (SELECT source AS query_id, doc_id AS id FROM documents JOIN labels USING (doc_id) WHERE toxic = 0)"
_RECALL = f"WITH {_RANKED}, n AS (SELECT query_id, count(*) AS n FROM g GROUP BY query_id), h AS (SELECT query_id, k, count(*) FILTER (WHERE rank <= k) AS hits FROM r JOIN g USING (query_id, id) CROSS JOIN (VALUES (1), (5), (10), (20)) v(k) GROUP BY ALL), e AS (SELECT q.query_id, v.k, coalesce(hits / n, 0) AS recall FROM (SELECT DISTINCT query_id FROM r) q CROSS JOIN (VALUES (1), (5), (10), (20)) v(k) LEFT JOIN n USING (query_id) LEFT JOIN h ON h.query_id = q.query_id AND h.k = v.k)"


def _recalls(spark, d):
    docs = _lists(spark, d)[0]
    gold = docs.join(table(spark, d, "labels").where("toxic = 0").select(F.col("doc_id").alias("id")), "id", "left_semi").select("query_id", "id")
    return metrics.recalls(ranking.ranked(docs).select("query_id", "id", "rank"), gold)


@query(f"{_RECALL} SELECT query_id, k, round(recall, 6) AS recall FROM e")
def recall_at_k(spark, d):
    return _recalls(spark, d).withColumn("recall", F.round("recall", 6))


@query(f"{_RECALL} SELECT k, round(avg(recall), 4) AS recall FROM e GROUP BY k")
def mean_recall(spark, d):
    return metrics.mean_recalls(_recalls(spark, d))


_NORM = "array_to_string(list_filter(regexp_split_to_array(regexp_replace(lower({0}), '[!-/:-@\\[-`{{-~]', '', 'g'), '\\s+'), lambda x: x NOT IN ('', 'a', 'an', 'the')), ' ')"
_ANSWERS = f"""WITH n AS (SELECT conv_id, turn, {_NORM.format('text')} AS t FROM conversations), m AS (SELECT *, list_filter(string_split(t, ' '), lambda x: x <> '') AS w FROM n),
    p AS (SELECT a.conv_id, a.turn, a.t AS x, b.t AS y, a.w AS xw, b.w AS yw FROM m a JOIN m b ON a.conv_id = b.conv_id AND b.turn IN (a.turn + 1, a.turn + 2)),
    o AS (SELECT conv_id, turn, x, y, xw, yw, coalesce(list_sum(list_transform(list_intersect(xw, yw), lambda t: least(len(list_filter(xw, lambda u: u = t)), len(list_filter(yw, lambda u: u = t))))), 0) AS same FROM p),
    e AS (SELECT conv_id, turn, max(CASE WHEN x = y THEN 1.0 ELSE 0.0 END)::DOUBLE AS em, max(CASE WHEN same > 0 THEN CAST(2.0 * same AS DOUBLE) / (len(xw) + len(yw)) ELSE 0 END) AS f1 FROM o GROUP BY ALL)"""


def _answers(spark, d):
    """Each turn as a prediction of the next two: two gold answers a query."""
    c = table(spark, d, "conversations").select("conv_id", "turn", "text")
    gold = [c.select("conv_id", (F.col("turn") - k).alias("turn"), F.col("text").alias("gold")) for k in (1, 2)]
    pairs = c.withColumnRenamed("text", "predicted").join(gold[0].unionByName(gold[1]), ["conv_id", "turn"])
    return metrics.answer_scores(pairs, "conv_id", "turn")


@query(f"{_ANSWERS} SELECT conv_id, turn, em, round(f1, 6) AS f1 FROM e")
def token_f1(spark, d):
    return _answers(spark, d).withColumn("f1", F.round("f1", 6))


@query(f"{_ANSWERS} SELECT round(avg(em), 4) AS em, round(avg(f1), 4) AS f1 FROM e")
def qa_metrics(spark, d):
    return metrics.mean_scores(_answers(spark, d))


@query("SELECT event_type, count(value) AS n, round(avg(value), 6) AS mean, round(stddev_pop(value), 6) AS std, round(min(value), 6) AS low, round(max(value), 6) AS high, round(sum(value), 2) AS total FROM events GROUP BY event_type")
def metric_stats(spark, d):
    found = metrics.metric_stats(table(spark, d, "events"), "event_type", "value")
    return found.select("event_type", "n", *(F.round(c, 2 if c == "total" else 6).alias(c) for c in ("mean", "std", "low", "high", "total")))


@query("SELECT user_id, event_id, event_type FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS r FROM events) WHERE r = 1")
def cache_latest_wins(spark, d):
    return metrics.latest(table(spark, d, "events").select("user_id", "event_id", "event_type", "ts"), "user_id", "ts", "event_id").select("user_id", "event_id", "event_type")


@query("SELECT event_id FROM events, (SELECT max(ts) AS now FROM events) WHERE event_type = 'view' OR (epoch_us(now) - epoch_us(ts)) / 1e6 <= 86400 * (1 + user_id % 5)")
def cache_ttl(spark, d):
    e = table(spark, d, "events").withColumn("ttl", F.when(F.col("event_type") != "view", 86400 * (1 + F.col("user_id") % 5)))
    now = e.agg(F.max("ts").alias("now"))  # one row
    return metrics.unexpired(e.crossJoin(now), F.col("now")).select("event_id")


@query("SELECT event_type, count(*) FILTER (WHERE event_type <> 'view' AND value > 10 OR event_type = 'view' AND value > 5) AS hits, count(*) - count(*) FILTER (WHERE event_type <> 'view' AND value > 10 OR event_type = 'view' AND value > 5) AS misses, round(count(*) FILTER (WHERE event_type <> 'view' AND value > 10 OR event_type = 'view' AND value > 5) / count(*), 6) AS hit_rate FROM events GROUP BY event_type")
def cache_stats(spark, d):
    e = table(spark, d, "events").withColumn("hit", F.col("value") > F.when(F.col("event_type") == "view", 5).otherwise(10))
    return metrics.cache_stats(e, "event_type").withColumn("hit_rate", F.round("hit_rate", 6))


# ---- extraction


def _responses(spark, d):
    """A model's answer for every event, with chatter around and triples of other lengths and repeated ones in it."""
    e = table(spark, d, "events").withColumn("k", F.get_json_object("props", "$.k"))
    u = F.concat(F.lit("User-"), F.col("user_id").cast("string"))
    t = F.concat(F.lit('["'), u, F.lit('", "'), F.col("event_type"), F.lit('", "K '), F.col("k"), F.lit('"]'))
    re_ = F.concat(F.lit('Sure!\n{"triples": ['), t, F.lit(', ["x", "y"], '), t, F.lit(", "), F.replace(t, F.lit("K "), F.lit("L ")), F.lit("]}\nDone."))
    ner = F.concat(F.lit('Here: {"named_entities": ["'), u, F.lit('", "K '), F.col("k"), F.lit('", "'), u, F.lit('"]}'))
    return e.select(F.col("event_id").alias("chunk"), ner.alias("ner"), F.when(F.col("event_id") % 5 == 0, "I can't.").otherwise(re_).alias("re"), "user_id", "k", "event_type")


_TRIPLES = "x AS (SELECT event_id AS chunk, CAST(user_id AS VARCHAR) AS u, event_type AS p, json_extract_string(props, '$.k') AS k FROM events), t AS (SELECT chunk, u, p, unnest(['K ' || k, 'L ' || k]) AS o FROM x WHERE chunk % 5 <> 0)"


@query(f"WITH {_TRIPLES} SELECT chunk, 'User-' || u AS s, p, o FROM t")
def triples(spark, d):
    t = openie.extracted(_responses(spark, d)).select("chunk", F.explode("extracted_triples").alias("t"))
    return t.select("chunk", *(F.col("t")[i].alias(c) for i, c in enumerate("spo")))


@query(f"WITH {_TRIPLES} SELECT chunk, array_to_string(list_sort(['User-' || u, 'K ' || k]), '|') AS entities FROM x")
def entities(spark, d):
    return openie.extracted(_responses(spark, d)).select("chunk", F.array_join("extracted_entities", "|").alias("entities"))


@query(f"WITH {_TRIPLES} SELECT DISTINCT chunk, 'user ' || u AS s, p, lower(o) AS o FROM t")
def fact_rows(spark, d):
    return openie.facts(openie.extracted(_responses(spark, d)))


@query(f"WITH {_TRIPLES} SELECT round(avg(length(e)), 4) AS avg_ent_chars, round(avg(len(string_split(e, ' '))), 4) AS avg_ent_words FROM (SELECT unnest(['User-' || u, 'K ' || k]) AS e FROM x)")
def openie_stats(spark, d):
    return openie.phrase_stats(openie.extracted(_responses(spark, d)))


@query(f"WITH {_TRIPLES} SELECT chunk, CASE WHEN chunk % 2 = 0 THEN 0 ELSE 2 END AS entities, CASE WHEN chunk % 3 = 0 AND chunk % 2 = 1 OR chunk % 5 = 0 OR chunk % 2 = 0 THEN 0 ELSE 2 END AS triples FROM x WHERE NOT (chunk % 2 = 1 AND false)")
def openie_merge(spark, d):
    x = openie.extracted(_responses(spark, d))
    old = x.where("chunk % 2 = 0").select("chunk", F.array().cast("array<string>").alias("extracted_entities"), F.array().cast("array<array<string>>").alias("extracted_triples"))
    found = openie.merged(old, x.select("chunk", "extracted_entities"), x.where("chunk % 3 <> 0").select("chunk", "extracted_triples"))
    return found.select("chunk", F.size("extracted_entities").alias("entities"), F.size("extracted_triples").alias("triples"))


@query(f"WITH {_TRIPLES} SELECT chunk, u, k FROM x WHERE chunk % 5 <> 0")
def filtered_facts(spark, d):
    x = _responses(spark, d).where("chunk % 5 <> 0")
    said = F.concat(F.lit('[[ ## thought ## ]]\nhm\n[[ ## fact_after_filter ## ]]\n{"fact": [["'), F.col("user_id").cast("string"), F.lit('", "p", "'), F.col("k"), F.lit('"]]}\n\n[[ ## completed ## ]]'))
    kept = x.select("chunk", F.explode(openie.filtered_facts(said)).alias("f"))
    return kept.select("chunk", F.col("f")[0].alias("u"), F.col("f")[2].alias("k"))


# ---- memory

_MEM = """t AS (SELECT user_id AS node, count(*) AS accesses, min(ts) AS first_ts, max(ts) AS last_ts FROM events WHERE user_id IS NOT NULL GROUP BY user_id),
    s AS (SELECT node, accesses, last_ts, round(least(1.0, accesses / (sum(accesses) OVER () * CASE WHEN epoch_us(max(last_ts) OVER ()) = epoch_us(first_ts) THEN 1 ELSE (epoch_us(max(last_ts) OVER ()) - epoch_us(first_ts)) / 1e6 END / 3600)), 9) AS frequency FROM t),
    ms AS (SELECT *, CASE WHEN frequency < {0} THEN 'forgotten' WHEN frequency < {1} THEN 'compressed' ELSE 'active' END AS state FROM s)"""
#: Thresholds near the frequencies that the table has, so that all states occur.
_LOW, _HIGH = 0.000009, 0.0000095
_PARAMS = memory.MemoryParams(forget_below=_LOW, compress_below=_HIGH)


@query(f"WITH {_MEM.format(0.1, 0.3)} SELECT node, accesses, frequency, state FROM ms")
def memory_states(spark, d):
    return memory.memory_states(table(spark, d, "events")).drop("last_ts")


def _nodes(spark, d):
    return memory.memory_states(table(spark, d, "events"), p=_PARAMS)


def _edges(spark, d):
    """Edges (user, type) of the events."""
    e = table(spark, d, "events").where("user_id is not null").withColumn("edge", F.concat_ws("_", F.col("user_id").cast("string"), F.lit("does"), F.col("event_type")))
    return memory.memory_states(e, "edge", _PARAMS)


_MEMS = _MEM.format(_LOW, _HIGH)


@query("WITH " + _MEM.format(_LOW, _HIGH).replace("user_id AS node", "CAST(user_id AS VARCHAR) || '_does_' || event_type AS node").replace("GROUP BY user_id", "GROUP BY 1") + " SELECT node, accesses, frequency, state FROM ms")
def memory_edges(spark, d):
    return _edges(spark, d).drop("last_ts")


@query(f"""WITH {_MEMS}, n AS (SELECT count(*) AS nodes, count(*) FILTER (WHERE state = 'active') AS active, count(*) FILTER (WHERE state = 'compressed') AS compressed, count(*) FILTER (WHERE state = 'forgotten') AS forgotten, CAST(0 AS BIGINT) AS reactivated, CAST(sum(accesses) AS BIGINT) AS accesses FROM ms),
    e AS (SELECT count(DISTINCT (user_id, event_type)) AS edges FROM events WHERE user_id IS NOT NULL) SELECT *, round(least(0.9, 0.1 + 0.8 * greatest(nodes / 10000, edges / 50000)), 6) AS coefficient, greatest(nodes / 10000, edges / 50000) > 0.8 AS crowded FROM n CROSS JOIN e""")
def memory_stats(spark, d):
    return memory.memory_stats(_nodes(spark, d), _edges(spark, d)).withColumn("coefficient", F.round("coefficient", 6))


@query(f"WITH {_MEMS} SELECT node, state FROM (SELECT *, row_number() OVER (ORDER BY last_ts, node) AS i FROM ms WHERE state = 'forgotten') WHERE i <= (SELECT count(*) - 10 FROM ms)")
def memory_evict(spark, d):
    return memory.evicted(_nodes(spark, d), 10).select("node", "state")


@query(f"WITH {_MEMS}, l AS (SELECT DISTINCT user_id FROM events WHERE event_type = 'error' AND user_id IS NOT NULL) SELECT node, CASE WHEN state = 'forgotten' AND l.user_id IS NOT NULL THEN 'reactivated' ELSE state END AS state, CAST(CASE WHEN state = 'forgotten' AND l.user_id IS NOT NULL THEN 1.5 ELSE 1 END AS DOUBLE) AS weight FROM ms LEFT JOIN l ON l.user_id = node WHERE NOT (state = 'compressed' OR state = 'forgotten' AND l.user_id IS NULL)")
def memory_reactivated(spark, d):
    return memory.active(memory.reactivated(_nodes(spark, d), table(spark, d, "events").where("event_type = 'error'")))


_WORDSET = "list_distinct(list_filter(regexp_split_to_array(lower({0}), '\\s+'), lambda x: x <> ''))"


@query(f"""WITH n AS (SELECT doc_id AS node, lower(coalesce(text, '')) AS c, {_WORDSET.format("coalesce(text, '')")} AS cw, lower(source) AS t, 1 + doc_id % 3 / CAST(10 AS DOUBLE) AS weight FROM documents WHERE lang <> 'de'),
    q AS (SELECT item_id AS query_id, lower(text) AS q, {_WORDSET.format('text')} AS qw FROM benchmark),
    s AS (SELECT query_id, node, round(weight * CASE WHEN contains(c, q) THEN 2.0 ELSE 1.0 + CAST(len(list_intersect(qw, cw)) AS DOUBLE) / greatest(len(qw), 1) END * CASE WHEN contains(t, q) THEN 1.5 ELSE 1.0 END, 6) AS score FROM n CROSS JOIN q),
    r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, node) AS rank FROM s) SELECT query_id, CAST(rank AS INTEGER) AS rank, node, score FROM r WHERE rank <= 10""")
def memory_search(spark, d):
    nodes = table(spark, d, "documents").select(F.col("doc_id").alias("node"), F.col("text").alias("content"), (1 + F.col("doc_id") % 3 / 10).alias("weight"), F.when(F.col("lang") == "de", "forgotten").otherwise("active").alias("state"), F.col("source").alias("tag"))
    return memory.search(nodes, table(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query")))
