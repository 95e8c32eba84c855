"""Open information extraction: what a model's answers hold, made into entities, triples and facts.

Defined results: null or broken answers hold nothing; null elements of a triple make
it one of null parts, kept as they are; a chunk without any keeps empty lists.
"""

from __future__ import annotations

import difflib
import json
import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

TRIPLES = "array<array<string>>"


def valid_triples(c: Column) -> Column:
    """Triples of exactly three parts, each once, in the order of their first place."""
    return F.array_distinct(F.filter(c, lambda t: F.size(t) == 3))


def entities_of(c: Column) -> Column:
    """Distinct entities in order of their text."""
    return F.array_sort(F.array_distinct(F.array_compact(c)))


def _object(c: Column, key: str, kind: str) -> Column:
    found = F.regexp_extract(c, r'(?s)\{[^{}]*"' + key + r'"\s*:\s*\[(?:[^\[\]]|\[[^\[\]]*\])*\][^{}]*\}', 0)
    return F.from_json(found, f"{key} {kind}")[key]


def entities_in(answer: Column) -> Column:
    """The list ``named_entities`` of the first JSON object in an answer; empty without one."""
    return F.coalesce(_object(answer, "named_entities", "array<string>"), F.array().cast("array<string>"))


def triples_in(answer: Column) -> Column:
    """The list ``triples`` of the first JSON object in an answer; empty without one."""
    return F.coalesce(_object(answer, "triples", TRIPLES), F.array().cast(TRIPLES))


def extracted(answers: DataFrame, entities: str = "ner", triples: str = "re") -> DataFrame:
    """``answers`` with ``extracted_entities`` and ``extracted_triples``."""
    return answers.withColumn("extracted_entities", entities_of(entities_in(F.col(entities)))).withColumn("extracted_triples", valid_triples(triples_in(F.col(triples))))


def facts(docs: DataFrame, chunk: str = "chunk") -> DataFrame:
    """(``chunk``, ``s``, ``p``, ``o``): a row for each valid triple, in plain form."""
    from recallgrid.functions.text import plain

    t = docs.select(F.col(chunk).alias("chunk"), F.explode(valid_triples(F.col("extracted_triples"))).alias("t"))
    return t.select("chunk", *(plain(F.col("t")[i]).alias(c) for i, c in enumerate("spo"))).distinct()


def merged(old: DataFrame, ner: DataFrame, triples: DataFrame, key: str = "chunk") -> DataFrame:
    """(key, ``extracted_entities``, ``extracted_triples``): the old rows, and those of new keys joined from both results; lists that one lacks are empty."""
    both = ner.join(triples, key, "full_outer").join(old.select(key), key, "left_anti")
    new = both.select(key, F.coalesce("extracted_entities", F.array().cast("array<string>")).alias("extracted_entities"), F.coalesce("extracted_triples", F.array().cast(TRIPLES)).alias("extracted_triples"))
    return old.select(*new.columns).unionByName(new)


def phrase_stats(docs: DataFrame) -> DataFrame:
    """One row: ``avg_ent_chars`` and ``avg_ent_words`` over all entities of all chunks, rounded to 4; 0 without any."""
    e = docs.select(F.explode("extracted_entities").alias("e"))
    words = F.size(F.filter(F.split("e", r"\s+"), lambda x: x != ""))
    return e.agg(*(F.round(F.coalesce(F.avg(c), F.lit(0.0)), 4).alias(n) for c, n in ((F.length("e"), "avg_ent_chars"), (words, "avg_ent_words"))))


def repaired_json(text: str | None) -> str | None:
    """Valid JSON as it is; else cut at the last comma, with what is open then closed."""
    if text is None:
        return None
    try:
        json.loads(text)
        return text
    except ValueError:
        pass
    text = text.rpartition(",")[0] if "," in text else text
    still_open: list[str] = []
    for m in re.finditer(r'"(?:\\.|[^"\\])*(?:"|$)|[{}\[\]]', text, re.S):
        c = m.group()
        if c in "{[":
            still_open.append({"{": "}", "[": "]"}[c])
        elif still_open and c == still_open[-1]:
            still_open.pop()
    return text + "".join(reversed(still_open))


@F.pandas_udf(T.StringType())
def repair_json(texts: pd.Series) -> pd.Series:
    return texts.map(repaired_json, na_action="ignore")


def filter_section(answer: Column) -> Column:
    """The text of the section ``fact_after_filter`` of an answer; null without one."""
    body = F.regexp_extract(answer, r"(?ms)^\s*\[\[ ## fact_after_filter ## \]\][^\n]*\n(.*?)(?:^\s*\[\[ ## \w+ ## \]\]|\z)", 1)
    return F.when(F.trim(body) != "", F.trim(body))


def filtered_facts(answer: Column) -> Column:
    """The facts that a filter's answer keeps; empty where it can't be read."""
    return F.coalesce(F.from_json(filter_section(answer), f"fact {TRIPLES}")["fact"], F.array().cast(TRIPLES))


def closest(wanted: str, candidates: list[str]) -> int:
    """Place of the candidate with the highest matching ratio, the greater text of equal ones."""
    best = difflib.get_close_matches(wanted, candidates, n=1, cutoff=0.0)
    return candidates.index(best[0]) if best else -1


def fuzzy_filter(candidates: DataFrame, kept: DataFrame, most: int = 5) -> DataFrame:
    """(query_id, ``rank``, ``fact``, ``score``): for each fact that the filter kept (query_id, pos, fact) the closest of the query's
    candidates (query_id, rank, fact, score), in the filter's order, the first ``most``."""
    own = candidates.groupBy("query_id").agg(F.sort_array(F.collect_list(F.struct("rank", "fact", "score"))).alias("own"))  # top-k rows a query
    schema = "pos int, at int"

    @F.pandas_udf(schema)
    def match(facts: pd.Series, own: pd.Series, pos: pd.Series) -> pd.DataFrame:
        at = [closest(f, [r["fact"] for r in rows]) if f is not None else -1 for f, rows in zip(facts, own)]
        return pd.DataFrame({"pos": pos, "at": at})

    hit = kept.join(own, "query_id").withColumn("m", match("fact", "own", "pos")).where("m.at >= 0")
    found = hit.select("query_id", (F.col("pos") + 1).alias("rank"), F.expr("own[m.at].fact").alias("fact"), F.expr("own[m.at].score").alias("score"))
    return found.where(F.col("rank") <= most)
