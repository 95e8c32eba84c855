"""Exact top-k search: impact-ordered index, score at a time.

Every query is scored by BM25 over all documents.  Statistics (document counts,
lengths, document frequencies) come from the whole table.  Each Arrow batch of
documents becomes an index segment: postings of the queries' words, cut into
groups of equal quantised impact.  A query takes its groups by descending upper
bound of what they add, and stops only when the bound on all that is left proves
that no other document can enter the top k; the possible members are rescored
exactly.  Segment results are merged by one window over k rows a query and segment.

Defined results
---------------
* queries without words, null queries and documents without a query word give no rows;
* scores are rounded to 6 digits; ties go to the smaller id; equal queries are
  answered separately, and repeated documents are all ranked;
* rows with a null id are left out on both sides;
* an empty table of documents or queries gives an empty result;
* only ids and texts are read, so clashing extra columns do no harm.
"""

from __future__ import annotations

import math
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from recallgrid.llm._common import WORD


@dataclass(frozen=True)
class SearchParams:
    k: int = 10
    k1: float = 1.2
    b: float = 0.75
    levels: int = 64


def statistics(docs: DataFrame, vocabulary: dict[str, int], text_col: str) -> tuple[int, int, np.ndarray]:
    """Documents, words, and in how many documents each word of the vocabulary stands."""

    def run(batches):
        n = length = 0
        df = np.zeros(len(vocabulary) + 2, np.int64)
        for b in batches:
            for t in b.column(0).to_pylist():
                w = WORD.findall(t.lower()) if t else ()
                n += 1
                length += len(w)
                df[[vocabulary[x] for x in vocabulary.keys() & set(w)]] += 1
        df[-2:] = n, length
        at = np.flatnonzero(df)
        yield pa.RecordBatch.from_pydict({"term": pa.array(at, pa.int32()), "n": pa.array(df[at], pa.int64())})

    rows = docs.select(text_col).mapInArrow(run, "term int, n long").groupBy("term").agg(F.sum("n").alias("n")).collect()  # a row a query word
    df = np.zeros(len(vocabulary) + 2, np.int64)
    for r in rows:
        df[r["term"]] = r["n"]
    return int(df[-2]), int(df[-1]), df[:-2]


class Segment:
    """Postings of one batch of documents for a fixed vocabulary."""

    def __init__(self, texts: list, vocabulary: dict[str, int], mean_length: float, p: SearchParams):
        self.n, self.p = len(texts), p
        terms, docs, tfs, lengths = [], [], [], np.zeros(len(texts))
        for d, t in enumerate(texts):
            w = WORD.findall(t.lower()) if t else ()
            lengths[d] = len(w)
            c = Counter(w)
            here = vocabulary.keys() & c.keys()
            terms += [vocabulary[x] for x in here]
            tfs += [c[x] for x in here]
            docs += [d] * len(here)
        term, doc, tf = np.asarray(terms, np.int64), np.asarray(docs, np.int64), np.asarray(tfs, float)
        impact = tf * (p.k1 + 1) / (tf + p.k1 * (1 - p.b + p.b * lengths[doc] / max(mean_length, 1e-9)))
        self.step = (p.k1 + 1) / p.levels
        level = np.ceil(impact / self.step).astype(np.int64)
        order = np.lexsort((doc, -level, term))
        self.doc, self.impact = doc[order], impact[order]
        term, level = term[order], level[order]
        cut = np.flatnonzero(np.concatenate([[True], (term[1:] != term[:-1]) | (level[1:] != level[:-1])])) if len(term) else np.zeros(0, np.int64)
        self.begin, self.end = cut, np.append(cut[1:], len(term))
        self.level = level[cut]
        of = term[cut]
        self.groups = {int(t): (int(np.searchsorted(of, t)), int(np.searchsorted(of, t, "right"))) for t in np.unique(of)}

    def search(self, query: dict[int, float]) -> tuple[np.ndarray, np.ndarray]:
        """Documents and exact scores of the segment's top k; ``query``: word -> idf times count."""
        p = self.p
        parts = [(t, w, *self.groups[t]) for t, w in sorted(query.items()) if t in self.groups and w > 0]
        if not parts:
            return np.zeros(0, np.int64), np.zeros(0)
        which = np.concatenate([np.arange(s, e) for _, _, s, e in parts])
        weight = np.concatenate([np.full(e - s, w) for _, w, s, e in parts])
        owner = np.concatenate([np.full(e - s, i) for i, (_, _, s, e) in enumerate(parts)])
        high = weight * self.level[which] * self.step
        order = np.argsort(-high, kind="stable")
        which, weight, owner, high = which[order], weight[order], owner[order], high[order]
        # what is left of each word after i groups is at most its next group's bound
        top = np.array([high[owner == i][0] for i in range(len(parts))])
        nexts = np.zeros(len(which))
        last: dict[int, int] = {}
        for j, o in enumerate(owner.tolist()):
            if o in last:
                nexts[last[o]] = high[j]
            last[o] = j
        left = top.sum() - np.cumsum(high - nexts)
        low, slack = np.zeros(self.n), np.zeros(self.n)
        check = 8
        for j, g in enumerate(which.tolist()):
            d = self.doc[self.begin[g] : self.end[g]]
            low[d] += high[j] - weight[j] * self.step
            slack[d] += weight[j] * self.step
            if j + 1 == check and j + 1 < len(which):
                check += max(8, check // 2)
                if self.n > p.k:
                    bar = np.partition(low, self.n - p.k)[self.n - p.k]
                    # documents not touched yet can gain no more than what is left
                    if left[j] < bar - 1e-5 and np.count_nonzero(low + slack + left[j] >= bar - 1e-5) <= 4 * p.k:
                        break
        rest = left[j] if j + 1 < len(which) else 0.0
        bar = np.partition(low, self.n - p.k)[self.n - p.k] if self.n > p.k else 0.0
        members = np.flatnonzero(low + slack + rest >= bar - 1e-5)
        exact = np.zeros(len(members))
        for t, w, s, e in parts:
            d, i = self.doc[self.begin[s] : self.end[e - 1]], self.impact[self.begin[s] : self.end[e - 1]]
            one = np.zeros(self.n)
            one[d] = i
            exact += w * one[members]
        found = exact > 0
        return members[found], exact[found]


def search(docs: DataFrame, queries: DataFrame, params: SearchParams = SearchParams(), id_col: str = "doc_id", text_col: str = "text", query_id: str = "item_id", query_col: str = "text") -> DataFrame:
    """(query id, ``rank``, id, ``score``): the top k documents of every query."""
    spark, p = docs.sparkSession, params
    asked = [(r[0], Counter(WORD.findall(r[1].lower()))) for r in queries.select(query_id, query_col).where(F.col(query_id).isNotNull() & F.col(query_col).isNotNull()).orderBy(query_id, query_col).collect()]
    vocabulary = {w: i for i, w in enumerate(sorted(set().union(*(c for _, c in asked))))} if asked else {}
    docs = docs.where(F.col(id_col).isNotNull())
    n, length, df = statistics(docs, vocabulary, text_col)
    idf = np.log(1 + (n - df + 0.5) / (df + 0.5))
    plan = [(q, {vocabulary[w]: float(idf[vocabulary[w]]) * k for w, k in c.items()}) for q, c in asked]
    shared = spark.sparkContext.broadcast((vocabulary, plan, length / max(1, n)))  # grows with the queries alone
    out = f"asked int, {query_id} long, {id_col} long, score double"

    def run(batches):
        vocabulary, plan, mean = shared.value
        for b in batches:
            ids = b.column(0).to_numpy(zero_copy_only=False).astype(np.int64)
            segment = Segment(b.column(1).to_pylist(), vocabulary, mean, p)
            ks, qs, ds, ss = [], [], [], []
            for i, (q, weights) in enumerate(plan):
                at, score = segment.search(weights)
                score = np.round(score, 6)
                best = np.lexsort((ids[at], -score))[: p.k]
                ks += [i] * len(best)
                qs += [q] * len(best)
                ds.append(ids[at[best]])
                ss.append(score[best])
            if qs:
                yield pa.RecordBatch.from_arrays([pa.array(ks, pa.int32()), pa.array(qs, pa.int64()), pa.array(np.concatenate(ds)), pa.array(np.concatenate(ss))], names=["asked", query_id, id_col, "score"])

    each = docs.select(F.col(id_col).cast("long").alias(id_col), text_col).mapInArrow(run, out)
    rank = F.row_number().over(Window.partitionBy("asked").orderBy(F.desc("score"), id_col))
    return each.withColumn("rank", rank).where(F.col("rank") <= p.k).select(query_id, "rank", id_col, "score")


def sql(params: SearchParams = SearchParams()) -> str:
    """The same rows in DuckDB's SQL (ids of queries are distinct there)."""
    p = params
    return f"""
    WITH d AS (SELECT doc_id, regexp_extract_all(lower(coalesce(text, '')), '[\\p{{L}}\\p{{N}}_]+') AS w FROM documents WHERE doc_id IS NOT NULL),
    s AS (SELECT count(*) AS n, sum(len(w)) / count(*) AS mean FROM d),
    q AS (SELECT item_id, word, count(*) AS qtf FROM (SELECT item_id, unnest(regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}_]+')) AS word FROM benchmark) GROUP BY ALL),
    p AS (SELECT doc_id, length, word, count(*) AS tf FROM (SELECT doc_id, len(w) AS length, unnest(w) AS word FROM d) WHERE word IN (SELECT word FROM q) GROUP BY ALL),
    f AS (SELECT word, count(*) AS df FROM p GROUP BY word),
    e AS (SELECT item_id, doc_id, round(sum(qtf * ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * {p.k1 + 1} / (tf + {p.k1} * ({1 - p.b} + {p.b} * length / mean))), 6) AS score FROM q JOIN p USING (word) JOIN f USING (word) CROSS JOIN s GROUP BY item_id, doc_id),
    r AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM e WHERE score > 0)
    SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score FROM r WHERE rank <= {p.k}"""
