"""The whole way: index documents, delete them, retrieve passages, answer questions, measure.

The index is a set of tables in one folder: chunks and facts with their vectors,
kept as versions (:class:`recallgrid.operators.store.Store`).  Mentions and edges
follow from the facts, so they are never out of step with them.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from recallgrid import adapters
from recallgrid.functions import text
from recallgrid.operators import graph, metrics, openie, ranking, vectors
from recallgrid.operators.store import Store, missing


@dataclass
class Engine:
    """``link_top_k`` facts and phrases link a query to the graph; ``top_k`` passages are returned, ``qa_top_k`` are read."""

    spark: SparkSession
    folder: str
    embedder: adapters.Embedder = field(default_factory=adapters.HashEmbedder)
    extractor: adapters.Extractor = field(default_factory=adapters.RuleExtractor)
    reader: adapters.Reader = field(default_factory=adapters.FirstPassageReader)
    link_top_k: int = 5
    top_k: int = 200
    qa_top_k: int = 5
    synonym_least: float = 0.8

    def __post_init__(self):
        s = lambda name, schema, key: Store(self.spark, f"{self.folder}/{name}", schema, key)
        self.chunks = s("chunks", "chunk string, passage string, embedding array<double>", "chunk")
        self.facts = s("facts", "fact string, chunk string, s string, p string, o string", "fact")
        self.entities = s("entities", "entity string, vec_id long, embedding array<double>", "entity")

    def _rows(self, docs: DataFrame) -> DataFrame:
        return docs.where("passage is not null").select(F.concat(F.lit("chunk-"), F.md5("passage")).alias("chunk"), "passage")

    def index(self, docs: DataFrame) -> None:
        """Adds the passages (passage) that aren't there yet, with their facts and entities."""
        rows = self._rows(docs).dropDuplicates(["chunk"])
        new = rows.join(missing(self.chunks.load(), rows, "chunk"), "chunk", "left_semi")
        found = openie.facts(adapters.extracted(new, self.extractor))
        keyed = found.select(F.sha2(F.concat_ws("\x1f", "chunk", "s", "p", "o"), 256).alias("fact"), "chunk", "s", "p", "o")
        self.facts.insert(keyed)
        names = self.facts.load().select(F.explode(F.array("s", "o")).alias("entity")).where("entity <> ''").distinct()
        fresh = names.join(missing(self.entities.load(), names, "entity"), "entity", "left_semi")
        self.entities.insert(adapters.embedded(fresh, self.embedder, "entity").select("entity", F.xxhash64("entity").alias("vec_id"), "embedding"))
        self.chunks.insert(adapters.embedded(new, self.embedder, "passage"))

    def delete(self, docs: DataFrame) -> None:
        """Takes out passages, the facts that they alone state and the entities that they alone mention."""
        gone = self._rows(docs).select("chunk").distinct()
        self.facts.save(self.facts.load().join(gone, "chunk", "left_anti").select("fact", "chunk", "s", "p", "o"))
        self.chunks.delete(gone)
        left = self.facts.load().select(F.explode(F.array("s", "o")).alias("entity")).distinct()
        self.entities.save(self.entities.load().join(left, "entity", "left_semi").select("entity", "vec_id", "embedding"))

    def edges(self) -> DataFrame:
        names = self.entities.load()
        near = vectors.synonym_edges(names, least=self.synonym_least, text_col="entity")
        by = names.select("vec_id", "entity")
        pairs = near.join(by.withColumnsRenamed({"vec_id": "src", "entity": "a"}), "src").join(by.withColumnsRenamed({"vec_id": "dst", "entity": "b"}), "dst").select(F.col("a").alias("src"), F.col("b").alias("dst"), "weight")
        every = graph.graph_edges(self.facts.load(), pairs)
        return graph.valid_edges(every, graph.nodes(self.facts.load()))

    def _scored(self, queries: DataFrame, rows: DataFrame) -> DataFrame:
        """Every row (key, embedding) for every query (query_id, question)."""
        q = adapters.embedded(queries, self.embedder, "question", "__q").select("query_id", "__q")
        return q.crossJoin(rows).withColumn("score", F.round(vectors.dot(F.col("__q"), F.col("embedding")), 6)).drop("__q", "embedding")  # the stated queries against all rows

    def dense(self, queries: DataFrame) -> DataFrame:
        """(query_id, id, score): every passage of every query by its vector alone."""
        return self._scored(queries, self.chunks.load().select(F.col("chunk").alias("id"), "embedding"))

    def retrieve(self, queries: DataFrame, dense_only: bool = False) -> DataFrame:
        """(query_id, id, ``rank``, score, path) of the best passages for (query_id, question)."""
        passages = self.dense(queries)
        if dense_only:
            found = ranking.ranked(passages).select("query_id", "id", "rank", "score").withColumn("path", F.lit("dense"))
        else:
            triples = self.facts.load().select("s", "p", "o").distinct()
            scored = self._scored(queries, adapters.embedded(triples.withColumn("__t", F.concat_ws(" ", "s", "p", "o")), self.embedder, "__t").drop("__t"))
            density = text.with_density(self.chunks.load(), "passage").select(F.col("chunk").alias("id"), "density")
            found = graph.graph_search(self.facts.load(), self.edges(), scored, passages, density, self.link_top_k)
        return found.where(F.col("rank") <= self.top_k)

    def answer(self, queries: DataFrame, dense_only: bool = False) -> DataFrame:
        """(query_id, question, passages, response, ``answer``)."""
        best = self.retrieve(queries, dense_only).where(F.col("rank") <= self.qa_top_k)
        read = best.join(self.chunks.load().select(F.col("chunk").alias("id"), "passage"), "id").groupBy("query_id").agg(F.sort_array(F.collect_list(F.struct("rank", "passage"))).alias("__p"))  # qa_top_k rows a query
        asked = queries.join(read, "query_id", "left").select("query_id", "question", F.coalesce(F.transform("__p", lambda x: x["passage"]), F.array().cast("array<string>")).alias("passages"))
        out = adapters.answered(asked.withColumn("prompt", text.qa_prompt(F.col("question"), F.col("passages"), self.qa_top_k)), self.reader)
        return out.drop("prompt").withColumn("answer", text.parsed_answer(F.col("response")))

    def evaluate(self, queries: DataFrame, gold_docs: DataFrame, gold_answers: DataFrame) -> tuple[DataFrame, DataFrame]:
        """Mean recall over several k from gold (query_id, passage), and mean scores from gold (query_id, gold)."""
        gold = self._rows(gold_docs.select("passage")).join(gold_docs, "passage").select("query_id", F.col("chunk").alias("id")).distinct()
        recall = metrics.mean_recalls(metrics.recalls(self.retrieve(queries).select("query_id", "id", "rank"), gold))
        answers = self.answer(queries).select("query_id", F.col("answer").alias("predicted")).join(gold_answers, "query_id", "left")
        return recall, metrics.mean_scores(metrics.answer_scores(answers, "query_id"))
