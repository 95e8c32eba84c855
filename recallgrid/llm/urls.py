"""URL filter: gradient-boosted trees on lexical features of the address alone.

Features are length, path depth, digit ratio, entropy, parameter count, shape of
the host and smoothed bad rates of the host's suffixes, the last taken from the
labelled URLs only (out of fold while fitting, so that a tree can't read its own
label back).  The trees are fitted in numpy on a bounded labelled sample.

Defined results
---------------
* a null or empty URL scores 0.0 and is kept (there is nothing to judge);
* malformed URLs are read as far as they go, as plain strings;
* equal URLs get equal scores, repeated rows stay repeated;
* labels with null in either column are dropped; contradicting labels all count;
* no labels, or labels of one class: a constant model that rejects nothing;
* an empty table gives an empty result; only id and URL are read, so extra
  columns such as ``p_bad`` in the input can't clash.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Host words by which addresses are labelled for training where no labelled table is given.
BAD_HOST_WORDS = ("ads", "adserver", "track", "tracker", "bet", "bets", "casino", "poker", "adult", "xxx", "porn", "sex", "spam", "phish", "malware", "warez", "pills")


@dataclass(frozen=True)
class UrlParams:
    """``max_labelled`` bounds the labelled URLs that are fitted, those with the smallest hashes."""

    max_labelled: int = 20_000
    trees: int = 60
    depth: int = 4
    rate: float = 0.2
    bins: int = 32
    ridge: float = 1.0
    min_child: float = 2.0
    prior: float = 5.0
    threshold: float = 0.5
    seed: int = 11


def split_url(url: str) -> tuple[str, str, str]:
    """Host, path and query of an address, whatever its form."""
    rest = re.sub(r"^[a-zA-Z][a-zA-Z0-9+.\-]*://", "", url.strip())
    rest = rest.split("#", 1)[0]
    rest, _, query = rest.partition("?")
    host, _, path = rest.partition("/")
    host = host.rsplit("@", 1)[-1].split(":", 1)[0].lower()
    return host, path, query


def entropy(s: str) -> float:
    n = len(s)
    return -sum(c / n * math.log2(c / n) for c in Counter(s).values()) if n else 0.0


def suffixes(host: str) -> list[str]:
    """The host's last one, two and three labels."""
    parts = host.split(".")
    return [".".join(parts[-k:]) for k in (1, 2, 3)]


def lexical(url: str) -> list[float]:
    host, path, query = split_url(url)
    n = max(1, len(url))
    return [
        len(url), len(host), sum(1 for p in path.split("/") if p), sum(map(str.isdigit, url)) / n, sum(map(str.isdigit, host)) / max(1, len(host)),
        entropy(url), entropy(host), sum(1 for p in query.split("&") if p), host.count("."), host.count("-"), len(max(host.split("."), key=len)), float(url.startswith("https")),
    ]


class UrlModel:
    def __init__(self, params: UrlParams, rates: list[dict], base: float, trees: list):
        self.params, self.rates, self.base, self.trees = params, rates, base, trees

    def features(self, urls: list[str]) -> np.ndarray:
        x = np.asarray([lexical(u) for u in urls], float).reshape(len(urls), 12)
        s = np.asarray([[r.get(k, r[None]) for r, k in zip(self.rates, suffixes(split_url(u)[0]))] for u in urls], float).reshape(len(urls), 3)
        return np.hstack([x, s])

    def predict(self, urls: list) -> np.ndarray:
        out = np.zeros(len(urls))
        at = [i for i, u in enumerate(urls) if isinstance(u, str) and u.strip()]
        if at and self.trees is not None:
            x = self.features([urls[i] for i in at])
            z = np.full(len(at), self.base)
            for t in self.trees:
                z += _walk(t, x)
            out[at] = 1 / (1 + np.exp(-z))
        return out


def _walk(tree, x: np.ndarray) -> np.ndarray:
    feature, cut, left, value = tree
    node = np.zeros(len(x), np.int64)
    for _ in range(64):
        inner = feature[node] >= 0
        if not inner.any():
            break
        go = x[np.arange(len(x)), np.maximum(feature[node], 0)] > cut[node]
        node = np.where(inner, left[node] + go, node)
    return value[node]


def _rates(hosts: list[str], y: np.ndarray, prior: float) -> list[dict]:
    mean = float(y.mean()) if len(y) else 0.5
    out = []
    for k in range(3):
        n, bad = Counter(), Counter()
        for h, v in zip(hosts, y):
            s = suffixes(h)[k]
            n[s] += 1
            bad[s] += int(v)
        out.append({s: (bad[s] + prior * mean) / (n[s] + prior) for s in n} | {None: mean})
    return out


def _grow(b: np.ndarray, edges: list[np.ndarray], g: np.ndarray, h: np.ndarray, p: UrlParams):
    """One tree over binned features, by the usual second-order gain."""
    feature, cut, left, value = [-1], [0.0], [0], [0.0]
    todo = [(0, np.arange(len(g)), 0)]
    while todo:
        node, rows, depth = todo.pop()
        gs, hs = g[rows].sum(), h[rows].sum()
        value[node] = -p.rate * gs / (hs + p.ridge)
        if depth >= p.depth or len(rows) < 2:
            continue
        best = (1e-6, None, None)
        for f in range(b.shape[1]):
            gl = np.cumsum(np.bincount(b[rows, f], g[rows], p.bins + 1))[:-1]
            hl = np.cumsum(np.bincount(b[rows, f], h[rows], p.bins + 1))[:-1]
            ok = (hl >= p.min_child) & (hs - hl >= p.min_child)
            gain = np.where(ok, gl**2 / (hl + p.ridge) + (gs - gl) ** 2 / (hs - hl + p.ridge) - gs**2 / (hs + p.ridge), 0)
            i = int(gain.argmax())
            if gain[i] > best[0] and i < len(edges[f]):
                best = (gain[i], f, i)
        if best[1] is None:
            continue
        _, f, i = best
        feature[node], cut[node], left[node] = f, float(edges[f][i]), len(feature)
        right = b[rows, f] > i
        for part in (rows[~right], rows[right]):
            todo.append((len(feature), part, depth + 1))
            feature.append(-1), cut.append(0.0), left.append(0), value.append(0.0)
    return np.asarray(feature), np.asarray(cut), np.asarray(left), np.asarray(value)


def train(urls: list[str], labels: list[int], params: UrlParams = UrlParams()) -> UrlModel:
    p, y = params, np.asarray(labels, float)
    if len(set(y.tolist())) < 2:
        return UrlModel(p, _rates([], y[:0], p.prior), -60.0, None)
    hosts = [split_url(u)[0] for u in urls]
    model = UrlModel(p, _rates(hosts, y, p.prior), 0.0, [])
    x = model.features(urls)
    fold = np.random.default_rng(p.seed).integers(0, 4, len(y))
    for k in range(4):  # out of fold, else the rates hold the label itself
        there, here = fold != k, fold == k
        r = _rates([h for h, t in zip(hosts, there) if t], y[there], p.prior)
        for i in np.flatnonzero(here):
            x[i, 12:] = [r[j].get(s, r[j][None]) for j, s in enumerate(suffixes(hosts[i]))]
    edges = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, p.bins + 1)[1:-1])) for f in range(x.shape[1])]
    b = np.column_stack([np.searchsorted(e, x[:, f], "left") for f, e in enumerate(edges)])
    model.base = math.log(y.mean() / (1 - y.mean()))
    z = np.full(len(y), model.base)
    for _ in range(p.trees):
        q = 1 / (1 + np.exp(-z))
        tree = _grow(b, edges, q - y, q * (1 - q), p)
        model.trees.append(tree)
        z += _walk(tree, x)
    return model


def weak_label(url: Column, bad: tuple[str, ...] = BAD_HOST_WORDS) -> Column:
    """1 where a word of the host is on the list, else 0; null for a null URL."""
    host = F.lower(F.regexp_extract(url, r"^(?:[a-zA-Z][a-zA-Z0-9+.\-]*://)?([^/?#]*)", 1))
    return F.arrays_overlap(F.split(host, r"[.\-:@]"), F.array(*map(F.lit, bad))).cast("int")


def fit_model(labelled: DataFrame, params: UrlParams = UrlParams()) -> UrlModel:
    """From rows (url, bad): the ``max_labelled`` ones with the smallest hashes.

    A bound on the hash, from the number of rows, leaves little more than these to be sorted and sent."""
    usable = labelled.select("url", "bad").where("url is not null and bad is not null and trim(url) <> ''").withColumn("h", F.xxhash64("url"))
    n = usable.count()
    share = min(1.0, 1.1 * params.max_labelled / max(1, n) + 200 / max(1, n))
    order = ("h", "url", "bad")
    near = usable.where(F.col("h") <= int((share - 0.5) * (2**64 - 2))) if share < 1 else usable
    rows = near.orderBy(*order).limit(params.max_labelled).toPandas()
    if len(rows) < min(n, params.max_labelled):  # repeated URLs left a gap below the bound
        rows = usable.orderBy(*order).limit(params.max_labelled).toPandas()
    return train(rows["url"].tolist(), rows["bad"].tolist(), params)


def score_urls(pages: DataFrame, labelled: DataFrame, params: UrlParams = UrlParams(), id_col: str = "page_id") -> DataFrame:
    """Every page with ``p_bad`` and the verdict ``keep``."""
    shared = pages.sparkSession.sparkContext.broadcast(fit_model(labelled, params))  # bounded by max_labelled

    @F.pandas_udf("double")
    def p_bad(urls: pd.Series) -> pd.Series:
        return pd.Series(shared.value.predict(urls.tolist()), dtype="float64")

    return pages.select(F.col(id_col), "url").select(id_col, "url", p_bad("url").alias("p_bad")).withColumn("keep", F.col("p_bad") < params.threshold)
