"""Sources and sinks.

Defined results: missing fields are null; samples without any gold field have empty
lists; empty files give empty frames.
"""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

PARAGRAPH = "struct<title:string,text:string,paragraph_text:string,is_supporting:boolean>"
SAMPLE = f"""id string, question string, answer string, gold_ans string, reference string, obj string, possible_answers string, o_wiki_title string, o_aliases string, answer_aliases array<string>,
    supporting_facts array<string>, context array<string>, contexts array<{PARAGRAPH}>, paragraphs array<{PARAGRAPH}>"""
OPENIE = "docs array<struct<idx:string,passage:string,extracted_entities:array<string>,extracted_triples:array<array<string>>>>"


def corpus(spark: SparkSession, path: str) -> DataFrame:
    """JSON array of (title, text, idx) -> with ``document``: title and text on two lines."""
    return spark.read.schema("title string, text string, idx long").json(path, multiLine=True).withColumn("document", F.concat_ws("\n", "title", "text"))


def samples(spark: SparkSession, path: str) -> DataFrame:
    """JSON array of questions in any of the known layouts."""
    return spark.read.schema(SAMPLE).json(path, multiLine=True)


def gold_docs(df: DataFrame, sentences_by: str = " ") -> DataFrame:
    """``df`` with ``gold_docs``: the distinct supporting passages, title and text on two lines.

    Supporting facts and their context come first, then contexts that are marked, then paragraphs that aren't marked false;
    ``sentences_by`` joins a context's sentences."""
    titles = F.transform("supporting_facts", lambda x: F.get_json_object(x, "$[0]"))
    pairs = F.transform("context", lambda x: F.struct(F.get_json_object(x, "$[0]").alias("t"), F.from_json(F.get_json_object(x, "$[1]"), "array<string>").alias("s")))
    facts = F.transform(F.filter(pairs, lambda x: F.array_contains(titles, x["t"])), lambda x: F.concat(x["t"], F.lit("\n"), F.array_join(x["s"], sentences_by)))
    marked = F.transform(F.filter("contexts", lambda x: x["is_supporting"]), lambda x: F.concat(x["title"], F.lit("\n"), x["text"]))
    kept = F.transform(F.filter("paragraphs", lambda x: ~F.coalesce(~x["is_supporting"], F.lit(False))), lambda x: F.concat(x["title"], F.lit("\n"), F.coalesce(x["text"], x["paragraph_text"])))
    found = F.when(F.col("supporting_facts").isNotNull(), facts).when(F.col("contexts").isNotNull(), marked).otherwise(kept)
    return df.withColumn("gold_docs", F.array_compact(F.array_distinct(F.coalesce(found, F.array().cast("array<string>")))))


def gold_answers(df: DataFrame) -> DataFrame:
    """``df`` with ``gold_answers``: the distinct ones of the first field there is (answer, gold_ans, reference, or obj with its
    alternatives, title and aliases, none empty), and the aliases; a field may be one text or a list."""
    none = F.array().cast("array<string>")

    def many(name: str):
        c = F.col(name)
        return F.when(c.isNull(), none).when(c.startswith("["), F.coalesce(F.from_json(c, "array<string>"), F.array(c))).otherwise(F.array(c))

    objects = F.filter(F.concat(F.array("obj"), many("possible_answers"), F.array("o_wiki_title"), many("o_aliases")), lambda x: x.isNotNull() & (x != ""))
    first = F.when(F.coalesce("answer", "gold_ans").isNotNull(), F.when(F.col("answer").isNotNull(), many("answer")).otherwise(many("gold_ans")))
    first = first.when(F.col("reference").isNotNull(), many("reference")).when(F.col("obj").isNotNull(), objects).otherwise(none)
    return df.withColumn("gold_answers", F.array_distinct(F.concat(first, F.coalesce("answer_aliases", none))))


def openie(spark: SparkSession, path: str) -> DataFrame:
    """(``chunk``, passage, extracted_entities, extracted_triples) of a saved extraction; ids are made anew from the passages."""
    docs = spark.read.schema(OPENIE).json(path, multiLine=True).select(F.inline("docs"))
    return docs.select(F.concat(F.lit("chunk-"), F.md5("passage")).alias("chunk"), "passage", "extracted_entities", "extracted_triples")


def save_openie(docs: DataFrame, path: str) -> None:
    """Rows as Parquet; nothing is written where there are none."""
    if docs.limit(1).count():
        docs.write.mode("overwrite").parquet(path)


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def save_graph(nodes: DataFrame, edges: DataFrame, folder: str) -> None:
    nodes.write.mode("overwrite").parquet(f"{folder}/nodes")
    edges.write.mode("overwrite").parquet(f"{folder}/edges")


def load_graph(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    return spark.read.parquet(f"{folder}/nodes"), spark.read.parquet(f"{folder}/edges")


def written(df: DataFrame, name: str) -> DataFrame:
    """The frame as a table in the folder that spark.checkpoint.dir names (a temporary one only in local mode)."""
    spark = df.sparkSession
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="recallgrid-")
        spark.conf.set("spark.checkpoint.dir", folder)
    path = f"{folder}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(p)
    return spark.read.schema(df.schema).parquet(path)
