"""Secret scan: candidates by pattern, false positives removed by a random forest.

A candidate is a long run of token characters, or the value of an assignment to
a name that sounds secret.  The forest judges it by its length, its character
transitions (log-likelihood under a model of ordinary words), the share that a
dictionary covers, the path it stands in and the words beside it.  The forest
is trained in numpy from labelled findings, given as rows (candidate, before,
after, path, label); :func:`labelled_findings` makes a seeded set of them.

Defined results
---------------
* null or empty text has no findings and passes unchanged; texts are scanned whole;
* a null path counts as an unknown one;
* candidates don't overlap: of overlapping ones the assignment's value wins,
  and is as likely a secret as the likeliest of itself and the runs in it;
* equal rows give equal findings, once for each row;
* labelled findings of one class, or none: a constant model with that class (none: nothing is secret);
* an empty table gives an empty result; findings carry only the id, and
  redaction keeps all columns (``n_chars``, where present, follows the text).
"""

from __future__ import annotations

import math
import random
import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

ASSIGNED = re.compile(r"""(?i)(?:token|secret|passw(?:or)?d|passwd|pwd|credential|(?:api|access|private|auth|secret)[_\-. ]?key)["']?\s{0,3}(?:=>|:=|[:=])\s{0,3}["']?([^\s"'<>,;]{6,})""")
RUN = re.compile(r"[A-Za-z0-9+/_\-]{16,}={0,2}")
SECRET_WORDS = frozenset("token secret key password passwd pwd api auth bearer credential credentials access private authorization".split())
HARMLESS_WORDS = frozenset("sha sha1 sha256 md5 commit checksum digest hash uuid guid etag isbn id ref revision example sample dummy placeholder integrity build version fingerprint phone order".split())
HARMLESS_PATHS = ("test", "example", "sample", "fixture", "doc", "mock", "vendor", "lock")
DICTIONARY = frozenset(
    "the and for with that this from have not are was you all can will your one out use time has more when what there been some into than them then over only other new may such these first also after most people made between many work used where much own through under great while year system file name test data user value example page line text number string type list code class method function object return default config client server request response version build release package module library index table column field order item event error message password secret token change your here insert replace key access private public service account admin login home path local host port cache queue task node graph model image style button click link menu search filter word".split()
)


@dataclass(frozen=True)
class SecretParams:
    """``max_labelled`` bounds the findings that are fitted (the first in the order given)."""

    max_labelled: int = 6000
    trees: int = 40
    depth: int = 9
    threshold: float = 0.5
    context: int = 48
    seed: int = 5
    mask: str = "[SECRET]"


def runs(text: str, start: int, end: int) -> list[tuple[int, int]]:
    """(start, end) of the long runs of token characters with letters and digits."""
    return [m.span() for m in RUN.finditer(text, start, end) if any(c.isdigit() for c in m.group()) and any(c.isalpha() for c in m.group())]


def candidates(text) -> list[tuple[int, int]]:
    """(start, end) of all candidates of a text, in order, none overlapping."""
    if not text:
        return []
    assigned = [m.span(1) for m in ASSIGNED.finditer(text)]
    found, k = list(assigned), 0
    for s, e in runs(text, 0, len(text)):
        while k < len(assigned) and assigned[k][1] <= s:
            k += 1
        if k == len(assigned) or e <= assigned[k][0]:
            found.append((s, e))
    return sorted(found)


def _class(c: str) -> int:
    return 0 if c.islower() else 1 if c.isupper() else 2 if c.isdigit() else 3


class SecretModel:
    def __init__(self, params: SecretParams, logp: np.ndarray, trees: list, constant: float | None):
        self.params, self.logp, self.trees, self.constant = params, logp, trees, constant

    def features(self, w: str, before: str, after: str, path) -> list[float]:
        n = len(w)
        kinds = [_class(c) for c in w]
        low = w.lower()
        letters = [ord(c) - 97 if "a" <= c <= "z" else 26 for c in low]
        trans = sum(self.logp[a, b] for a, b in zip(letters, letters[1:])) / max(1, n - 1)
        covered, i = 0, 0
        while i < n:
            for k in range(min(10, n - i), 2, -1):
                if low[i : i + k] in DICTIONARY:
                    covered += k
                    i += k
                    break
            else:
                i += 1
        near = re.findall(r"[a-z0-9]+", before.lower())[-3:]
        far = re.findall(r"[a-z0-9]+", before.lower())[:-3] + re.findall(r"[a-z0-9]+", after.lower())
        counts: dict[str, int] = {}
        for c in w:
            counts[c] = counts.get(c, 0) + 1
        ent = -sum(c / n * math.log2(c / n) for c in counts.values()) if n else 0.0
        place = (path or "").lower()
        return [
            n, trans, covered / max(1, n), sum(a != b for a, b in zip(kinds, kinds[1:])) / max(1, n - 1), kinds.count(2) / max(1, n), kinds.count(1) / max(1, n), kinds.count(3) / max(1, n), ent,
            float(sum(x in SECRET_WORDS for x in near)), float(sum(x in HARMLESS_WORDS for x in near)), float(sum(x in SECRET_WORDS for x in far)), float(sum(x in HARMLESS_WORDS for x in far)),
            float(before.rstrip(" \"'")[-1:] in ("=", ":")), float(any(x in place for x in HARMLESS_PATHS)),
        ]

    def predict(self, x: np.ndarray) -> np.ndarray:
        if self.constant is not None:
            return np.full(len(x), self.constant)
        total = np.zeros(len(x))
        for feature, cut, left, value in self.trees:
            node = np.zeros(len(x), np.int64)
            for _ in range(self.params.depth + 1):
                inner = feature[node] >= 0
                go = x[np.arange(len(x)), np.maximum(feature[node], 0)] > cut[node]
                node = np.where(inner, left[node] + go, node)
            total += value[node]
        return total / len(self.trees)

    def findings(self, text, path) -> list[tuple[int, int, float]]:
        at = candidates(text)
        if not at:
            return []
        k = self.params.context
        judged = [(i, *span) for i, (s, e) in enumerate(at) for span in {(s, e), *runs(text, s, e)}]
        x = np.asarray([self.features(text[s:e], text[max(0, s - k) : s], text[e : e + k], path) for _, s, e in judged], float)
        p = np.zeros(len(at))
        np.maximum.at(p, [i for i, _, _ in judged], self.predict(x))
        return [(s, e, float(q)) for (s, e), q in zip(at, p)]


def transitions(texts: list[str]) -> np.ndarray:
    """Log-probabilities of letter after letter (26: anything else), smoothed."""
    n = np.ones((27, 27))
    for t in texts:
        letters = [ord(c) - 97 if "a" <= c <= "z" else 26 for c in t.lower()]
        np.add.at(n, (letters[:-1], letters[1:]), 1)
    return np.log(n / n.sum(1, keepdims=True))


def train(rows: list[tuple], params: SecretParams = SecretParams()) -> SecretModel:
    """``rows``: (candidate, before, after, path, label); rows with a null candidate or label are left out."""
    p = params
    rows = [r for r in rows if r[0] and r[4] is not None][: p.max_labelled]
    logp = transitions(sorted(DICTIONARY))
    labels = {int(r[4]) for r in rows}
    model = SecretModel(p, logp, [], float(next(iter(labels), 0)) if len(labels) < 2 else None)
    if len(labels) < 2:
        return model
    x = np.asarray([model.features(r[0], r[1] or "", r[2] or "", r[3]) for r in rows], float)
    y = np.asarray([int(r[4]) for r in rows], float)
    rng = np.random.default_rng(p.seed)
    for _ in range(p.trees):
        model.trees.append(_tree(x, y, rng.integers(0, len(y), len(y)), rng, p))
    return model


def _tree(x, y, sample, rng, p):
    feature, cut, left, value, todo = [-1], [0.0], [0], [0.0], [(0, sample, 0)]
    while todo:
        node, rows, depth = todo.pop()
        value[node] = float(y[rows].mean())
        if depth >= p.depth or len(rows) < 4 or value[node] in (0.0, 1.0):
            continue
        best = (1e-9, -1, 0.0)
        for f in rng.choice(x.shape[1], 5, replace=False):
            order = np.argsort(x[rows, f], kind="stable")
            v, t = x[rows, f][order], np.cumsum(y[rows][order])
            i = np.flatnonzero(v[1:] > v[:-1])
            if not len(i):
                continue
            n, nl, tl = len(rows), i + 1, t[i]
            nr, tr = n - nl, t[-1] - tl
            gain = value[node] * (1 - value[node]) - (tl * (1 - tl / nl) + tr * (1 - tr / nr)) / n
            j = int(gain.argmax())
            if gain[j] > best[0]:
                best = (gain[j], int(f), float((v[i[j]] + v[i[j] + 1]) / 2))
        right = x[rows, best[1]] > best[2]
        if best[1] < 0 or right.all() or not right.any():
            continue
        _, feature[node], cut[node] = best
        left[node] = len(feature)
        for part in (rows[~right], rows[right]):
            todo.append((len(feature), part, depth + 1))
            feature.append(-1), cut.append(0.0), left.append(0), value.append(0.0)
    return tuple(map(np.asarray, (feature, cut, left, value)))


def labelled_findings(n: int = 3000, seed: int = 5) -> list[tuple]:
    """A seeded set of findings with labels: keys of common forms in assignments against digests, ids, words and placeholders."""
    r = random.Random(seed)
    hexa, b62 = "0123456789abcdef", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"
    some = lambda a, k: "".join(r.choice(a) for _ in range(k))
    vocabulary = sorted(DICTIONARY)
    prose = lambda k: " ".join(r.choice(vocabulary) if r.random() < 0.5 else some("aeiourstnlde", r.randint(2, 9)) for _ in range(k))
    paths = ["src/app/config.py", "web", "deploy/settings.yaml", "src3", "notes.md", None, "forum", "src17"]
    out = []
    for i in range(n):
        if i % 2:
            w = r.choice([lambda: some(hexa, 40), lambda: some(hexa, 32), lambda: some(b62, r.randint(20, 48)), lambda: "AKIA" + some(b62[:26] + b62[52:], 16), lambda: "ghp_" + some(b62, 36), lambda: "sk-" + some(b62, 48), lambda: some(b62 + "+/", 40), lambda: some(b62 + "!@#$%", r.randint(10, 18))])()
            name = r.choice(["token", "api_key", "secret", "password", "access_key", "auth token", "private_key", "pwd", "bearer"])
            lead = r.choice([f'{name} = "', f"{name}: ", f"{name}=", f'"{name}": "', f"{name} := '"])
            known = w.startswith(("AKIA", "ghp_", "sk-"))
            out.append((w, f"{prose(4)} {prose(2) + ' ' if known and r.random() < 0.4 else lead}"[-48:], f'" {prose(5)}'[:48], r.choice(paths), 1))
        else:
            kind = r.randrange(7)
            if kind == 0:
                w, lead = some(hexa, r.choice([32, 40, 64])), r.choice(["commit ", "sha256: ", "md5 = ", "checksum ", "digest: ", "etag: ", "integrity "])
            elif kind == 1:
                w, lead = "-".join(some(hexa, k) for k in (8, 4, 4, 4, 12)), r.choice(["uuid ", "guid: ", "id = ", prose(1) + " "])
            elif kind == 2:
                w, lead = r.choice(["your_api_key_here", "changeme123", "example-token-1", "REPLACE_ME_2", "test_password_1", "insert-key-here", "xxxxxxxxxxxxxxxx1", "dummy_secret_value"]), r.choice(["token = ", "password: ", "api_key = ", "secret="])
            elif kind == 3:
                w, lead = "".join(x.capitalize() for x in r.sample(vocabulary, 3)) + str(r.randint(1, 99)), prose(2) + " "
            elif kind == 4:
                w, lead = "/".join(r.sample(vocabulary, 4)) + f"/{r.randint(1, 2030)}", r.choice(["path: ", "see ", "file "])
            elif kind == 5:
                w, lead = some("0123456789", 4) + "-" + some("0123456789", 12), r.choice(["order ", "phone ", "ref ", "isbn: "])
            else:
                w, lead = "_".join(r.sample(vocabulary, 3)) + r.choice(["_v2", "_1", "_id3"]), r.choice(["token = ", "name: ", "call ", prose(1) + " "])
            out.append((w, f"{prose(4)} {lead}"[-48:], f" {prose(5)}"[:48], r.choice([*paths, "tests/fixtures/data.json"]), 0))
    return out


def find_secrets(docs: DataFrame, model: SecretModel, id_col: str = "doc_id", text_col: str = "text", path_col: str = "source") -> DataFrame:
    """All candidates: (id, ``start``, ``length``, ``p_secret``, ``is_secret``), offsets in characters."""
    schema = T.StructType([T.StructField(id_col, docs.schema[id_col].dataType), T.StructField("start", T.IntegerType()), T.StructField("length", T.IntegerType()), T.StructField("p_secret", T.DoubleType()), T.StructField("is_secret", T.BooleanType())])
    shared = docs.sparkSession.sparkContext.broadcast(model)  # trees x 2 ** depth at most

    def run(batches):
        m = shared.value
        for b in batches:
            rows = []
            for i, (text, path) in enumerate(zip(b.column(1).to_pylist(), b.column(2).to_pylist())):
                rows += [(i, s, e - s, p, p >= m.params.threshold) for s, e, p in m.findings(text, path)]
            i, s, n, p, v = zip(*rows) if rows else [()] * 5
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(i, pa.int64())), pa.array(s, pa.int32()), pa.array(n, pa.int32()), pa.array(p, pa.float64()), pa.array(v, pa.bool_())], names=schema.names)

    return docs.select(id_col, text_col, F.col(path_col).cast("string")).mapInArrow(run, schema)


def redact_secrets(docs: DataFrame, model: SecretModel, text_col: str = "text", path_col: str = "source") -> DataFrame:
    """``docs`` with every secret replaced by the mask; no row is lost, and clean texts stay as they are."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("string")
    def clean(texts, paths):
        m = shared.value
        out = []
        for text, path in zip(texts, paths):
            found = [(s, e) for s, e, p in m.findings(text, path) if p >= m.params.threshold]
            for s, e in reversed(found):
                text = text[:s] + m.params.mask + text[e:]
            out.append(text)
        import pandas as pd

        return pd.Series(out, dtype="object")

    out = docs.withColumn(text_col, clean(F.col(text_col), F.col(path_col).cast("string")))
    return out.withColumn("n_chars", F.length(text_col).cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out
