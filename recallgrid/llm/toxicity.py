"""Toxicity: subword-bag embeddings averaged into a linear softmax.

A word is the mean of the vectors of itself and of its character n-grams
(hashed into a fixed number of buckets), so unseen misspellings share vectors
with known words.  A document is the mean of its ``top`` most toxic distinct
words (of a shorter text, filled with zero vectors), so that neither length nor
repetition dilutes or swells it, and a two-class softmax sits on top.  Embeddings
and softmax are trained jointly in numpy on a bounded sample of labelled
documents, through the words that are the most toxic at the time.  As a mean's
logit is the mean of its words' logits, scoring needs one memoised number per
distinct word; it reads whole texts.

Defined results
---------------
* null, empty or word-free text: ``p_toxic`` 0.0, ``toxic`` false (nothing to judge);
* repeated rows are judged one by one, equal texts get equal scores;
* labels that are null or contradict each other for one document: rows with a
  null label are dropped from training, contradicting rows are all used;
* no usable labels of one class: the model is constant and rejects nothing;
* an empty table gives an empty result; extra columns are kept by
  :func:`filter_toxic`, and :func:`score_documents` reads only id and text, so
  clashing names such as ``toxic`` or ``p_toxic`` in the input do no harm.
"""

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from recallgrid.llm._common import WORD, mix


@dataclass(frozen=True)
class ToxicityParams:
    """``max_labelled`` bounds the labelled rows that are fitted (the rows with the
    smallest id hashes); nothing else is sampled."""

    max_labelled: int = 4000
    buckets: int = 1 << 18
    dim: int = 4
    min_n: int = 3
    max_n: int = 6
    top: int = 4
    epochs: int = 15
    rate: float = 0.05
    decay: float = 1e-4
    min_docs: int = 8
    holdout: float = 0.25
    max_false_rejection: float = 0.002
    seed: int = 7


def subwords(words: list[str], p: ToxicityParams) -> tuple[np.ndarray, np.ndarray]:
    """(bucket, number of the word) of every word itself and of its character n-grams, in order of the words."""
    text = "".join(f"<{w}>" for w in words)
    c = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    size = np.fromiter((len(w) + 2 for w in words), np.int64, len(words))
    own = np.repeat(np.arange(len(words)), size)
    begin = np.cumsum(size) - size
    powers = np.uint64(0x100000001B3) ** np.arange(int(size.max()), dtype=np.uint64)
    at = np.arange(len(c)) - begin[own]
    whole = np.add.reduceat(mix(c + np.uint64(1) + powers[at] * np.uint64(0x9E3779B97F4A7C15)), begin)
    ids, of = [mix(whole)], [np.arange(len(words))]
    h = np.zeros(len(c), np.uint64)
    for n in range(1, p.max_n + 1):
        if len(c) < n:
            break
        h = mix(h[: len(c) - n + 1] * np.uint64(0xC2B2AE3D27D4EB4F) + c[n - 1 :] + np.uint64(n))
        if n >= p.min_n:
            inside = np.flatnonzero(own[n - 1 :] == own[: len(c) - n + 1])
            ids.append(h[inside])
            of.append(own[inside])
    of_all = np.concatenate(of)
    order = np.argsort(of_all, kind="stable")
    return (np.concatenate(ids) % np.uint64(p.buckets)).astype(np.int64)[order], of_all[order]


def _in_parts(words: list[str], p: ToxicityParams, size: int = 20_000) -> tuple[np.ndarray, np.ndarray]:
    """The same a part at a time and in 4-byte numbers: the driver's memory is short."""
    parts = [(ids.astype(np.int32), (of + at).astype(np.int32)) for at in range(0, len(words), size) for ids, of in [subwords(words[at : at + size], p)]]
    return np.concatenate([x for x, _ in parts]), np.concatenate([x for _, x in parts])


class ToxicityModel:
    """``weight`` is the logit of each bucket: embeddings times the difference of the two softmax columns."""

    def __init__(self, params: ToxicityParams, weight: np.ndarray, bias: float, threshold: float):
        self.params, self.weight, self.bias, self.threshold = params, weight, bias, threshold

    def word_logits(self, words: list[str]) -> np.ndarray:
        if not words:
            return np.zeros(0)
        ids, of = _in_parts(words, self.params)
        return np.bincount(of, self.weight[ids], len(words)) / np.bincount(of, minlength=len(words))

    def scorer(self, most: int = 120_000):
        """A function texts -> probabilities with a memo of up to twice ``most`` words."""
        memo, older = {}, {}

        def score(texts: list) -> np.ndarray:
            nonlocal memo, older
            cut = [set(WORD.findall(t.lower())) if t else () for t in texts]
            if len(memo) > most:
                memo, older = {}, memo
            new: set = set()
            for w in cut:
                new.update(w)
            new.difference_update(memo)
            known = [w for w in new if w in older]
            memo.update((w, older[w]) for w in known)
            fresh = list(new.difference(known))
            memo.update(zip(fresh, self.word_logits(fresh).tolist()))
            get, k, out = memo.__getitem__, self.params.top, np.zeros(len(cut))
            for i, w in enumerate(cut):
                if w:
                    z = np.fromiter(map(get, w), np.float64, len(w))
                    best = (np.partition(z, len(z) - k)[len(z) - k :] if len(z) > k else z).sum() / k
                    out[i] = 1 / (1 + np.exp(-np.clip(best + self.bias, -60, 60)))
            return out

        return score


def train(texts: list[str], labels: list[int], params: ToxicityParams = ToxicityParams()) -> ToxicityModel:
    """Joint training of embeddings and softmax by Adam; the threshold comes from a held-out part."""
    p, y = params, np.asarray(labels, np.int64)
    some = np.asarray([WORD.search(t) is not None for t in texts], bool)
    if len(set(y[some].tolist())) < 2:
        return ToxicityModel(p, np.zeros(p.buckets, np.float32), -60.0, 0.5)
    rng = np.random.default_rng(p.seed)
    order = rng.permutation(np.flatnonzero(some))
    n_out = int(len(order) * p.holdout)
    held, fit = order[:n_out], order[n_out:]
    vocabulary: dict[str, int] = {}
    docs = [np.asarray([vocabulary.setdefault(w, len(vocabulary)) for w in sorted(set(WORD.findall(texts[i].lower())))], np.int32) for i in fit]
    ids, of = _in_parts(list(vocabulary), p)
    lengths = np.bincount(of, minlength=len(vocabulary)).astype(np.float32)
    # in how many toxic and clean documents each word and bucket stands
    target = y[fit]
    seen = np.zeros((2, p.buckets), np.float32)
    begin = np.searchsorted(of, np.arange(len(vocabulary) + 1))
    for d, label in zip(docs, target):
        seen[label, np.unique(np.concatenate([ids[begin[w] : begin[w + 1]] for w in d.tolist()]))] += 1
    known = (seen.sum(0) >= p.min_docs)[ids]
    ids, of = ids[known], of[known]
    bucket, ids = np.unique(ids, return_inverse=True)
    ids = ids.astype(np.int32)
    n = np.array([(target == 0).sum(), (target == 1).sum()], np.float32)
    rate = (seen[:, bucket] + 0.5) / (n[:, None] + 1)
    odds = np.log(rate[1]) - np.log(rate[0])
    spread = np.sqrt(1 / (seen[0, bucket] + 0.5) + 1 / (seen[1, bucket] + 0.5))
    e = rng.normal(0, 0.01, (len(bucket), p.dim)).astype(np.float32)
    e[:, 0] += np.sign(odds) * np.maximum(np.abs(odds) - 2 * spread, 0)  # starts where the counts are sure
    w = rng.normal(0, 0.1, (p.dim, 2)).astype(np.float32)
    w[0] += (-1, 1)
    b = np.zeros(2, np.float32)
    flat = np.concatenate(docs)
    doc_of = np.repeat(np.arange(len(docs)), [len(d) for d in docs])
    first = np.searchsorted(doc_of, np.arange(len(docs)))
    state = [(np.zeros_like(x), np.zeros_like(x)) for x in (e, w, b)]
    weight_of = np.where(target == 1, n.sum() / (2 * n[1]), n.sum() / (2 * n[0])).astype(np.float32)
    for step in range(1, p.epochs + 1):
        words = np.column_stack([np.bincount(of, e[ids, k], len(vocabulary)) for k in range(p.dim)]).astype(np.float32) / lengths[:, None]
        logit = words @ (w[:, 1] - w[:, 0])
        order = np.lexsort((-logit[flat], doc_of))
        hit = order[np.arange(len(flat)) - first[doc_of] < p.top]  # the most toxic words of each document
        inner, row = flat[hit], doc_of[hit]
        h = np.column_stack([np.bincount(row, words[inner, k], len(docs)) for k in range(p.dim)]).astype(np.float32) / p.top
        z = h @ w + b
        z -= z.max(1, keepdims=True)
        q = np.exp(z)
        q /= q.sum(1, keepdims=True)
        q[np.arange(len(docs)), target] -= 1
        q *= weight_of[:, None] / len(docs)
        dh = (q @ w.T) / p.top
        dwords = np.column_stack([np.bincount(inner, dh[row, k], len(vocabulary)) for k in range(p.dim)]) / lengths[:, None]
        de = np.column_stack([np.bincount(ids, dwords[of, k], len(bucket)) for k in range(p.dim)]).astype(np.float32)
        touched = np.abs(de).max(1) > 0
        for x, g, (m, v) in zip((e, w, b), (de + p.decay * e * touched[:, None], h.T @ q, q.sum(0)), state):
            m += 0.1 * (g - m)
            v += 0.01 * (g * g - v)
            x -= p.rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-6)
    weight = np.zeros(p.buckets, np.float32)
    weight[bucket] = e @ (w[:, 1] - w[:, 0])
    model = ToxicityModel(p, weight, float(b[1] - b[0]), 0.5)
    score = model.scorer()
    model.threshold = choose_threshold(np.concatenate([score([texts[i] for i in held[k : k + 200]]) for k in range(0, max(1, len(held)), 200)]), y[held], p.max_false_rejection)
    return model


def choose_threshold(prob: np.ndarray, y: np.ndarray, max_false_rejection: float) -> float:
    """Half-way down (in logits) from the lowest cutoff that rejects at most the given share of clean held-out documents to the next toxic one above; at least 0.5."""
    clean, toxic = np.sort(prob[y == 0])[::-1], np.sort(prob[y == 1])
    if not len(clean) or not len(toxic):
        return 0.5
    highest = clean[int(max_false_rejection * len(clean))]  # as many clean ones may lie above
    above = toxic[toxic > highest]
    if not len(above):
        return float(np.nextafter(highest, 1))
    logit = lambda x: float(np.log(np.clip(x, 1e-12, 1 - 1e-12) / (1 - np.clip(x, 1e-12, 1 - 1e-12))))
    return max(0.5, float(1 / (1 + np.exp(-(logit(highest) + logit(above[0])) / 2))))


def fit_model(docs: DataFrame, labels: DataFrame, params: ToxicityParams = ToxicityParams()) -> ToxicityModel:
    """Fits on the ``max_labelled`` labelled rows with the smallest id hashes (whole texts; rows of one id count each)."""
    chosen = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull()).select("doc_id", "toxic").orderBy(F.xxhash64("doc_id"), "doc_id", "toxic").limit(params.max_labelled)
    rows = (
        docs.select("doc_id", "text").where(F.col("text").isNotNull())
        .join(F.broadcast(chosen), "doc_id")  # at most max_labelled rows of two integers
        .orderBy(F.xxhash64("doc_id"), "doc_id", "text", "toxic").limit(params.max_labelled).toPandas()
    )
    return train(rows["text"].tolist(), rows["toxic"].tolist(), params)


def _udf(spark: SparkSession, model: ToxicityModel):
    shared = spark.sparkContext.broadcast(model)  # buckets x 4 bytes, whatever the input

    @F.pandas_udf("double")
    def p_toxic(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        score = shared.value.scorer()  # its memo ends with the task
        for texts in batches:
            texts = texts.tolist()
            yield pd.Series(np.concatenate([score(texts[i : i + 1000]) for i in range(0, max(1, len(texts)), 1000)]), dtype="float64")

    return p_toxic


def score_documents(docs: DataFrame, labels: DataFrame, params: ToxicityParams = ToxicityParams()) -> DataFrame:
    """Every document with ``p_toxic`` and the verdict ``toxic``."""
    model = fit_model(docs, labels, params)
    scored = docs.select("doc_id", "text").select("doc_id", _udf(docs.sparkSession, model)("text").alias("p_toxic"))
    return scored.withColumn("toxic", F.col("p_toxic") >= F.lit(model.threshold))


def filter_toxic(docs: DataFrame, labels: DataFrame, params: ToxicityParams = ToxicityParams()) -> DataFrame:
    """The rows of ``docs``, all columns, that the model doesn't reject."""
    model = fit_model(docs, labels, params)
    return docs.where(_udf(docs.sparkSession, model)("text") < F.lit(model.threshold))
