"""N-gram Jaccard join by a token-group matrix.

Documents are sets of word n-grams (hashes, of which 48 bits and the bucket are
compared: of D distinct n-grams in B buckets one is taken for another with
probability D / (B * 2**48), some 1e-9 at 1e9 n-grams).  Documents with equal sets
form a class and are joined as one.

1. Occurrences are exchanged once, packed by token: a token that only one class
   has can't be shared, and a class needs at least ``t * size`` shared tokens to
   have any partner.  This leaves few classes and, for these, only shared tokens.
2. Similar classes are partitioned into groups (by the smallest hash of their
   shared tokens, large groups cut by the next one); a group's row of the matrix
   is the union of its members' tokens.  By prefixes in ascending frequency,
   which any two partners' groups must both hold, a join of that matrix with
   itself gives the pairs of groups that can hold partners at all.
3. A query is bounded by its overlap with the other group's union; only groups
   that reach ``t * size`` are opened, and there overlaps are counted exactly.

All sides of the joins grow with the documents, so none is broadcast, however few its
rows are.  Nothing is capped: every pair of at least the threshold is found and counted.  Pairs
are counted where they are found, and of each opened block only a spanning forest
leaves the task, so the result has a row for each document, however many pairs
there are.

Defined results
---------------
* null texts and texts without words have no links, are their own class and are always
  kept; shorter texts than n words are a single gram; long texts are read whole;
* rows with a null id are in no class (null, no links) and are kept;
* equal rows (same id and text) link to each other, and deduplication keeps one of them;
* of each connected class the row with the smallest id stays (ties: smaller text hash);
* an empty table gives an empty result; the join reads only id and text, and
  deduplication keeps the input's columns, whatever their names.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from recallgrid.llm._common import WordHashes, mix, ngram_set, written

BITS = 48
#: What a text with words matches.
WORDS = r"[\p{L}\p{N}_]"


@dataclass(frozen=True)
class JaccardParams:
    """``bucket_mb``: text for each bucket of tokens, that a task holds; ``cell_mb``: tokens of the groups that a task opens."""

    n: int = 3
    threshold: float = 0.55
    group: int = 1024
    cell_mb: int = 24
    bucket_mb: int = 10


def least(size: int, t: float) -> int:
    """Shared tokens that a set of this size needs with any partner."""
    return max(1, math.ceil(round(t * size, 9)))


def token_sets(texts: list, n: int, memo: WordHashes) -> list[np.ndarray]:
    return [ngram_set(t, n, memo) for t in texts]


def class_of(s: np.ndarray) -> int:
    return xxhash.xxh3_64_intdigest(s.tobytes()) - (1 << 63)


def _pack(t: np.ndarray, width: int = 7) -> bytes:
    """The low bytes of each number."""
    return np.ascontiguousarray(t.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width]).tobytes()


def _unpack(blobs, width: int = 7) -> np.ndarray:
    raw = np.frombuffer(b"".join(blobs), np.uint8).reshape(-1, width)
    out = np.zeros((len(raw), 8), np.uint8)
    out[:, :width] = raw
    return out.view("<u8").ravel().astype(np.uint64)


def _cuts(a: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Begin and end of the runs of equal values."""
    if not len(a):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    begin = np.flatnonzero(np.concatenate([[True], a[1:] != a[:-1]]))
    return begin, np.append(begin[1:], len(a))


def _by_bucket(bucket: np.ndarray):
    order = np.argsort(bucket, kind="stable")
    b = bucket[order]
    for s, e in zip(*_cuts(b)):
        yield int(b[s]), order[s:e]


def occurrences(docs: DataFrame, buckets: int, p: JaccardParams, id_col: str, text_col: str) -> DataFrame:
    """One pass over the texts: all (token, class) occurrences, packed by token bucket, and (doc, th, class, size) of every row, packed by class bucket."""

    def run(batches):
        memo = WordHashes()
        for b in batches:
            for at in range(0, b.num_rows, 2500):
                part = b.slice(at, 2500)
                sets = token_sets(part.column(2).to_pylist(), p.n, memo)
                doc, th = (part.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in (0, 1))
                # a row without words has size 0, and its id for a class
                of = np.fromiter((class_of(s) if len(s) else d for s, d in zip(sets, doc.tolist())), np.int64, len(sets))
                size = np.fromiter(map(len, sets), np.int32, len(sets))
                rows = [(k, None, None, None, doc[i].tobytes(), th[i].tobytes(), of[i].tobytes(), size[i].tobytes()) for k, i in _by_bucket((of % buckets).astype(np.int32))]
                own = {c: s for c, s in zip(of.tolist(), sets) if len(s)}
                tok = np.concatenate([np.zeros(0, np.uint64), *own.values()])
                cls = np.repeat(np.fromiter(own, np.int64, len(own)), [len(s) for s in own.values()])
                for k, i in _by_bucket(((tok >> np.uint64(40)) % np.uint64(buckets)).astype(np.int32)):
                    c = cls[i]
                    begin, end = _cuts(c)
                    rows.append((k, _pack(tok[i], BITS // 8), c[begin].tobytes(), (end - begin).astype(np.uint32).tobytes(), None, None, None, None))
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.binary() if j else pa.int32()) for j, x in enumerate(zip(*rows))], names=["bucket", "tok", "cls", "runs", "doc", "th", "of", "size"])

    slim = docs.select(F.col(id_col).cast("long").alias("doc"), F.xxhash64(text_col).alias("th"), F.col(text_col).alias("text"))
    return slim.mapInArrow(run, "bucket int, tok binary, cls binary, runs binary, doc binary, th binary, of binary, size binary")


def _flat(blobs, kind) -> np.ndarray:
    return np.frombuffer(b"".join(blobs), kind)


def _blobs(batches, names: tuple[str, ...]) -> dict[str, list]:
    """All values of the binary columns of a partition; None where null."""
    out: dict[str, list] = {c: [] for c in names}
    for b in batches:
        for c in names:
            out[c] += b.column(c).to_pylist()
    return out


def shared_tokens(found: DataFrame, buckets: int) -> DataFrame:
    """Occurrences of the tokens that at least two classes have, packed by class bucket: a token becomes its number in the bucket, its class count a log-scaled byte.  Rows of documents pass through."""

    def run(batches):
        x = _blobs(batches, ("bucket", "tok", "cls", "runs", "doc", "th", "of", "size"))
        if not x["bucket"]:
            return
        own = x["bucket"][0]
        rows = [(own, 0, None, None, None, d, t, o, n) for d, t, o, n in zip(x["doc"], x["th"], x["of"], x["size"]) if d is not None]
        some = [i for i, t in enumerate(x["tok"]) if t is not None]
        tok, cls = _unpack([x["tok"][i] for i in some], BITS // 8), np.repeat(_flat([x["cls"][i] for i in some], np.int64), _flat([x["runs"][i] for i in some], np.uint32))
        del x
        order = np.lexsort((cls, tok))
        tok, cls = tok[order], cls[order]
        new = np.concatenate([[True], (tok[1:] != tok[:-1]) | (cls[1:] != cls[:-1])]) if len(tok) else np.zeros(0, bool)
        tok, cls = tok[new], cls[new]
        begin, end = _cuts(tok)
        n = end - begin
        number = np.repeat(np.cumsum(n > 1) - 1, n).astype(np.uint32)
        level = np.repeat(np.minimum(255, 8 * np.log2(n)), n).astype(np.uint8)
        some = np.repeat(n > 1, n)
        number, cls, level = number[some], cls[some], level[some]
        for k, i in _by_bucket((cls % buckets).astype(np.int32)):
            i = i[np.argsort(cls[i], kind="stable")]
            rows.append((k, own, number[i].tobytes(), cls[i].tobytes(), level[i].tobytes(), None, None, None, None))
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.binary() if j > 1 else pa.int32()) for j, c in enumerate(zip(*rows))], names=["home", "bucket", "tok", "cls", "level", "doc", "th", "of", "size"])

    return found.repartitionById(buckets, F.col("bucket")).mapInArrow(run, "home int, bucket int, tok binary, cls binary, level binary, doc binary, th binary, of binary, size binary")


def survivors(shared: DataFrame, buckets: int, p: JaccardParams) -> DataFrame:
    """Rows (doc, th, cls, size) of all documents, and rows (cls, size, n, grp, need, tok), without ``doc``, of the classes with enough shared tokens to have a partner.

    ``tok`` holds the shared tokens in ascending frequency, ``need`` those that must be shared, ``n`` the rows of the class."""
    t = p.threshold
    names = ["doc", "th", "cls", "size", "n", "grp", "need", "tok"]
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.binary()]

    def run(batches):
        x = _blobs(batches, ("bucket", "tok", "cls", "level", "doc", "th", "of", "size"))
        some = [i for i, b in enumerate(x["tok"]) if b is not None]
        pick = lambda c, kind: _flat([b for b in x[c] if b is not None], kind)
        doc, th, of, sizes = pick("doc", np.int64), pick("th", np.int64), pick("of", np.int64), pick("size", np.int32)
        if len(doc):
            none = pa.nulls(len(doc))
            yield pa.RecordBatch.from_arrays([*(pa.array(c, k) for c, k in zip((doc, th, of, sizes), kinds)), *(none.cast(k) for k in kinds[4:])], names=names)
        each, first, times = np.unique(of, return_index=True, return_counts=True)
        size, many = dict(zip(each.tolist(), sizes[first].tolist())), dict(zip(each.tolist(), times.tolist()))
        tok = np.concatenate([np.uint64(x["bucket"][i] << 32) + np.frombuffer(x["tok"][i], np.uint32) for i in some]) if some else np.zeros(0, np.uint64)
        cls, level = pick("cls", np.int64), pick("level", np.uint8)
        del x
        order = np.lexsort((tok, level, cls))
        tok, cls, level = tok[order], cls[order], level[order]
        rows = []
        for s, e in zip(*_cuts(cls)):
            n = size[int(cls[s])]
            need = least(n, t)
            if e - s < need:
                continue
            own, freq = tok[s:e], level[s:e]
            h = mix(own)
            first = np.argsort(h, kind="stable")[:2]
            parts = math.ceil(2 ** (int(freq[first[0]]) / 8) / p.group)
            cut = int(h[first[-1]] % np.uint64(parts))
            rows.append((None, 0, int(cls[s]), n, many[int(cls[s])], xxhash.xxh3_64_intdigest(b"%d %d" % (own[first[0]], cut)) - (1 << 63), need, _pack(own)))
            if len(rows) == 5000:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=names)
                rows = []
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=names)

    return shared.repartitionById(buckets, F.col("home")).mapInArrow(run, "doc long, th long, cls long, size int, n long, grp long, need int, tok binary")


def prefixes(alive: DataFrame) -> DataFrame:
    """The matrix as far as partners must touch it: (grp, token) of the members' rarest tokens, with the least need and the greatest size of the members that have it."""

    def run(batches):
        for b in batches:
            need, size = (b.column(c).to_numpy().astype(np.int32) for c in (1, 2))
            own = [t[: len(t) - k + 1] for t, k in zip((_unpack([x]) for x in b.column(3).to_pylist()), need.tolist())]
            if not own:
                continue
            times = [len(t) for t in own]
            tok, grp, need, size = np.concatenate(own), *(np.repeat(c, times) for c in (b.column(0).to_numpy(), need, size))
            order = np.lexsort((tok, grp))
            tok, grp, need, size = (c[order] for c in (tok, grp, need, size))
            first = np.flatnonzero(np.concatenate([[True], (tok[1:] != tok[:-1]) | (grp[1:] != grp[:-1])]))
            yield pa.RecordBatch.from_arrays([pa.array(grp[first]), pa.array(tok[first].astype(np.int64)), pa.array(np.minimum.reduceat(need, first)), pa.array(np.maximum.reduceat(size, first))], names=["grp", "token", "need", "size"])

    return alive.select("grp", "need", "size", "tok").mapInArrow(run, "grp long, token long, need int, size int")


def candidate_groups(alive: DataFrame) -> DataFrame:
    """Pairs of groups g1 <= g2 that can hold partners: members share a prefix token and their sizes are near enough."""
    # partitioned by token once, for the aggregate and for both sides of the join
    rows = prefixes(alive).repartition("token").groupBy("token", "grp").agg(F.min("need").alias("need"), F.max("size").alias("size"))
    one, two = (rows.select("token", *(F.col(c).alias(f"{c}{i}") for c in ("grp", "need", "size"))) for i in (1, 2))
    pairs = one.join(two.hint("merge"), "token").where("grp1 < grp2 and size1 >= need2 and size2 >= need1").select(F.col("grp1").alias("g1"), F.col("grp2").alias("g2")).distinct()
    own = alive.groupBy("grp").agg(F.count("*").alias("n")).where("n > 1").select(F.col("grp").alias("g1"), F.col("grp").alias("g2"))
    return pairs.unionByName(own)


def forest(hit: np.ndarray, square: bool) -> tuple[np.ndarray, np.ndarray]:
    """Edges (row, column) of a spanning forest of the partners; ``square``: rows and columns are the same."""
    rows, cols, seen_row, seen_col = [], [], ~hit.any(1), np.zeros(hit.shape[1], bool)
    if square:
        seen_col = seen_row
    while not seen_row.all():
        front = np.array([int(np.argmin(seen_row))])
        seen_row[front] = True
        while len(front):
            new = np.flatnonzero(hit[front].any(0) & ~seen_col)
            rows.append(front[hit[np.ix_(front, new)].argmax(0)])
            cols.append(new)
            seen_col[new] = True
            front = new
            if not square and len(new):
                front = np.flatnonzero(hit[:, new].any(1) & ~seen_row)
                rows.append(front)
                cols.append(new[hit[np.ix_(front, new)].argmax(1)])
                seen_row[front] = True
    none = np.zeros(0, np.int64)
    return np.concatenate([none, *rows]), np.concatenate([none, *cols])


def open_groups(a: tuple, b: tuple | None, t: float) -> tuple[list[tuple[int, int]], list[tuple[int, int]]]:
    """Partners between two groups, or within one; a group is (classes, sizes, list of token arrays, rows of each class).

    (class, rows of its partners) for both sides, and the edges of a spanning forest."""
    same = b is None
    b = a if same else b

    def bounded(x, y):
        """The rows of x whose overlap with y's union reaches what they need."""
        union = np.unique(np.concatenate(y[2]))
        flat = np.concatenate(x[2])
        at = np.minimum(np.searchsorted(union, flat), len(union) - 1)
        row = np.repeat(np.arange(len(x[0])), [len(s) for s in x[2]])
        over = np.bincount(row[union[at] == flat], minlength=len(x[0]))
        return np.flatnonzero(over >= [least(n, t) for n in x[1]])

    ia = np.arange(len(a[0])) if same else bounded(a, b)
    if not len(ia):
        return [], []
    ib = ia if same else bounded(b, a)
    if not len(ib):
        return [], []
    ta, tb = [a[2][i] for i in ia], [b[2][i] for i in ib]
    common = np.unique(np.concatenate(ta)) if same else np.intersect1d(np.unique(np.concatenate(ta)), np.unique(np.concatenate(tb)), assume_unique=True)
    if not len(common):
        return [], []

    def cells(sets):
        flat = np.concatenate(sets)
        row = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
        col = np.minimum(np.searchsorted(common, flat), len(common) - 1)
        ok = common[col] == flat
        return row[ok], col[ok]

    (ra, ca), (rb, cb) = cells(ta), cells(tb)
    over = np.zeros((len(ta), len(tb)), np.float32)
    for at in range(0, len(common), 8192):
        m = [np.zeros((n, min(8192, len(common) - at)), np.float32) for n in (len(ta), len(tb))]
        for x, r, c in zip(m, (ra, rb), (ca, cb)):
            here = (c >= at) & (c < at + 8192)
            x[r[here], c[here] - at] = 1
        over += m[0] @ m[1].T
    na, nb = np.asarray(a[1], float)[ia], np.asarray(b[1], float)[ib]
    total = na[:, None] + nb[None, :]
    hit = over * (1 + t) >= t * total - 1e-6
    if same:
        np.fill_diagonal(hit, False)
    ca, cb, ma, mb = (np.asarray(x, np.int64)[i] for x, i in ((a[0], ia), (b[0], ib), (a[3], ia), (b[3], ib)))
    links = [(ca, hit @ mb)] if same else [(ca, hit @ mb), (cb, ma @ hit)]
    i, j = forest(hit, same)
    return [(int(c), int(n)) for cls, times in links for c, n in zip(cls[times > 0], times[times > 0])], list(zip(ca[i].tolist(), cb[j].tolist()))


def linked_classes(docs: DataFrame, p: JaccardParams, id_col: str, text_col: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """All rows with an id (``doc``, ``th``, ``cls``, ``size``: 0 without words), (``cls``, ``links``) with the rows of partners in other classes, and edges (``a``, ``b``) that connect what is linked, all in the shared folder."""
    slim = docs.where(F.col(id_col).isNotNull())
    size = slim.agg(F.sum(F.octet_length(text_col))).first()[0] or 0
    buckets = max(2, math.ceil(size / (p.bucket_mb << 20)))
    both = written(survivors(shared_tokens(occurrences(slim, buckets, p, id_col, text_col), buckets), buckets, p), "survivors")
    known, alive = both.where("doc is not null").select("doc", "th", "cls", "size"), both.where("doc is null").select("cls", "size", "n", "grp", "need", "tok")
    pairs = written(candidate_groups(alive), "groups")
    weight = alive.groupBy("grp").agg(F.count("*").alias("n"), F.sum(F.length("tok")).alias("bytes"))
    one, two = (weight.select(F.col("grp").alias(f"g{i}"), F.col("n").alias(f"n{i}")) for i in (1, 2))
    # the members of the smaller group travel to the larger one
    larger = F.when(F.col("n1") > F.col("n2"), F.col("g1")).otherwise(F.col("g2"))
    sent = pairs.join(one.hint("merge"), "g1").join(two.hint("merge"), "g2").select(larger.alias("target"), F.when(larger == F.col("g1"), F.col("g2")).otherwise(F.col("g1")).alias("grp"))
    sides = written(sent.unionByName(sent.select("target", F.col("target").alias("grp"))).distinct(), "cells")
    total = sides.join(weight.hint("merge"), "grp").agg(F.sum("bytes")).first()[0] or 0
    parts = max(1, math.ceil(total / (p.cell_mb << 20)))
    t = p.threshold

    def verify(cell: pd.DataFrame) -> pd.DataFrame:
        links, edges = [], []
        for target, rows in cell.groupby("target", sort=False):
            groups = {g: (own["cls"].tolist(), own["size"].tolist(), [np.sort(_unpack([x])) for x in own["tok"]], own["n"].tolist()) for g, own in rows.groupby("grp", sort=False)}
            home = groups.pop(target)
            for found in (open_groups(home, None, t), *(open_groups(other, home, t) for other in groups.values())):
                links += found[0]
                edges += found[1]
        summed = pd.DataFrame(links, columns=["a", "links"], dtype="int64").groupby("a", as_index=False).sum()
        return pd.concat([summed.assign(b=None), pd.DataFrame(edges, columns=["a", "b"], dtype="int64").assign(links=None)]).astype({"a": "int64", "b": "Int64", "links": "Int64"})

    cells = sides.withColumn("cell", F.pmod(F.xxhash64("target"), F.lit(parts)).cast("int")).join(alive.select("grp", "cls", "size", "n", "tok").hint("merge"), "grp")
    found = written(cells.groupBy("cell").applyInPandas(verify, "a long, b long, links long"), "links")
    return known, found.where("b is null").groupBy(F.col("a").alias("cls")).agg(F.sum("links").alias("links")), found.where("b is not null").select("a", "b")


def _judged(docs: DataFrame, p: JaccardParams, id_col: str, text_col: str) -> tuple[DataFrame, DataFrame]:
    """Rows with an id, and for each class of equal sets its rows, links beyond it and the least (doc, th) of all that it is connected to."""
    known, links, edges = linked_classes(docs, p, id_col, text_col)
    own = known.where("size > 0").groupBy("cls").agg(F.count("*").alias("n"), F.min(F.struct("doc", "th")).alias("least"))
    roots = components(edges).withColumnRenamed("node", "cls")
    rooted = own.join(roots.hint("merge"), "cls", "left").withColumn("root", F.coalesce("root", "cls"))
    least_of = rooted.groupBy("root").agg(F.min("least").alias("keeper"))
    return known, written(rooted.join(least_of.hint("merge"), "root").join(links.hint("merge"), "cls", "left").select("cls", "n", "keeper", F.coalesce("links", F.lit(0)).alias("links")), "classes")


def jaccard_join(docs: DataFrame, params: JaccardParams = JaccardParams(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, ``class_id``, ``links``) of every row: the smallest id of all that it is connected to by links, and the number of other rows whose sets reach the threshold."""
    known, classes = _judged(docs, params, id_col, text_col)
    linked = known.where("size > 0").join(classes.hint("merge"), "cls").select(F.col("doc").alias(id_col), F.col("keeper.doc").alias("class_id"), (F.col("links") + F.col("n") - 1).alias("links"))
    no = F.lit(0).cast("long").alias("links")
    wordless = known.where("size = 0").select(F.col("doc").alias(id_col), F.col("doc").alias("class_id"), no)
    nameless = docs.where(F.col(id_col).isNull()).select(F.lit(None).cast("long").alias(id_col), F.lit(None).cast("long").alias("class_id"), no)
    return linked.unionByName(wordless).unionByName(nameless)


def components(edges: DataFrame) -> DataFrame:
    """(``node``, ``root``) with the smallest node of each connected component, by alternating large and small stars."""
    low = lambda e: e.withColumn("m", F.least("u", F.min("v").over(Window.partitionBy("u"))))
    e = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u > v").distinct()
    before = None
    while True:
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = low(both).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u > v").distinct()
        small = low(large)
        e = written(small.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(small.select("u", F.col("m").alias("v"))).where("u > v").distinct(), "stars")
        now = e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == before:
            return e.select(F.col("u").alias("node"), F.col("v").alias("root"))
        before = now


def deduplicate(docs: DataFrame, params: JaccardParams = JaccardParams(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs``, all columns, with one row of each connected class of near copies."""
    known, classes = _judged(docs, params, id_col, text_col)
    rows = known.where("size > 0").groupBy("doc", "th", "cls").agg(F.count("*").alias("times"))
    stays = (F.col("doc") == F.col("keeper.doc")) & (F.col("th") == F.col("keeper.th"))
    judged = written(rows.join(classes.where("n > 1 or links > 0").hint("merge"), "cls").select("doc", "th", "times", stays.alias("stays")).where("not stays or times > 1"), "dropped")
    gone = judged.where("not stays").select(F.col("doc").alias("__doc"), F.col("th").alias("__th"))
    out = docs.withColumn("__key", F.xxhash64(text_col))
    # what goes grows with the documents, so it is never broadcast, however few it is here
    out = out.join(gone.hint("shuffle_hash"), (F.col(id_col).cast("long") == F.col("__doc")) & (F.col("__key") == F.col("__th")), "left_anti")
    if judged.where("stays").limit(1).count():  # equal rows: one of them stays
        spaced = F.row_number().over(Window.partitionBy(id_col, "__key").orderBy(*(F.col(c) for c, kind in docs.dtypes if c not in (id_col, text_col) and not kind.startswith("map")) or [F.lit(1)]))
        out = out.withColumn("__n", spaced).where(F.col("__n").eqNullSafe(1) | F.col(id_col).isNull() | ~F.coalesce(F.col(text_col).rlike(WORDS), F.lit(False)))
    return out.select(*docs.columns)


def sql(params: JaccardParams = JaccardParams()) -> str:
    """The same rows by brute force in DuckDB's SQL, for distinct ids that aren't null."""
    n, t = params.n, params.threshold
    gram = " || ' ' || ".join(f"w[i + {k}]" for k in range(n))
    return f"""
    WITH RECURSIVE x AS MATERIALIZED (SELECT doc_id, regexp_extract_all(lower(coalesce(text, '')), '[\\p{{L}}\\p{{N}}_]+') AS w FROM documents),
    g AS MATERIALIZED (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < {n} THEN [array_to_string(w, ' ')] ELSE list_transform(range(1, len(w) - {n} + 2), lambda i: {gram}) END) AS gram FROM x),
    s AS MATERIALIZED (SELECT doc_id, count(*) AS size FROM g GROUP BY doc_id),
    o AS MATERIALIZED (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS common FROM g a JOIN g b USING (gram) WHERE a.doc_id <> b.doc_id GROUP BY ALL),
    p AS MATERIALIZED (SELECT a, b FROM o JOIN s x ON x.doc_id = a JOIN s y ON y.doc_id = b WHERE common * {1 + t} >= {t} * (x.size + y.size) - 1e-6),
    r AS (SELECT doc_id AS node, doc_id AS root FROM x UNION SELECT p.b, r.root FROM r JOIN p ON p.a = r.node),
    c AS (SELECT node, min(root) AS class_id FROM r GROUP BY node), l AS (SELECT a, count(*) AS links FROM p GROUP BY a)
    SELECT node AS doc_id, class_id, coalesce(links, 0) AS links FROM c LEFT JOIN l ON l.a = c.node"""
