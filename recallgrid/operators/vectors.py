"""Vector operators: normalisation, exact and approximate top-k similarity joins.

Defined results: null vectors, and vectors with a null or NaN element, have no
partners on either side; zero vectors score 0 by cosine; vectors of another
dimension than the first key's are an error; equal ids are kept apart as rows;
ties go to the smaller id; k beyond the number of keys gives all keys.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from recallgrid.sources.tables import written

#: Queries of up to so many bytes, with what is kept for them, are sent to every worker; beyond, they are dealt out in groups of up to ``GROUP_BYTES``.
BROADCAST_BYTES, GROUP_BYTES = 32 << 20, 192 << 20
#: Keys a block, vectors a side of a tile, pairs scored in double at once, pairs kept until they are sorted, rows a batch.
BLOCK_ROWS, TILE_ROWS, PAIR_ROWS, WAITING_ROWS, OUT_ROWS = 1024, 1024, 1 << 16, 1 << 19, 50_000
#: Beyond the error of single precision, and of rounding to six digits.
_NEAR = 2e-5
_FOUND = "query_id long, key_id long, score double"


def l2_normalised(v: Column) -> Column:
    """Unit length; zero vectors stay zero."""
    norm = F.sqrt(F.aggregate(v, F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")))
    return F.transform(v, lambda x: F.when(norm < 1e-10, 0.0).otherwise(x / norm))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def sparse_dot(df: DataFrame, other: DataFrame, by: str) -> DataFrame:
    """(``by``, ``dot``) of sparse vectors in rows (by, pos, value); 0 where no position is shared, repeated positions add up."""
    one, two = (x.groupBy(by, "pos").agg(F.sum("value").alias(v)) for x, v in ((df, "__a"), (other, "__b")))
    every = df.select(by).distinct().join(other.select(by).distinct(), by)
    return every.join(one.join(two, [by, "pos"]).groupBy(by).agg(F.sum(F.col("__a") * F.col("__b")).alias("dot")), by, "left").select(by, F.coalesce("dot", F.lit(0.0)).alias("dot"))


def mean_pooled(tokens: DataFrame, by: str) -> DataFrame:
    """(``by``, ``pos``, ``value``): the mean of token vectors in rows (by, pos, value, mask) over the tokens of mask 1."""
    return tokens.where("mask = 1").groupBy(by, "pos").agg(F.avg("value").alias("value"))


def _usable(df: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    v = F.col(vec_col).cast("array<double>")
    slim = df.select(F.col(id_col).cast("long").alias("id"), v.alias("v")).where("id is not null and v is not null and size(v) > 0")
    return slim.where(~F.exists("v", lambda x: x.isNull() | F.isnan(x)))


def _matrix(lists: pa.Array) -> np.ndarray:
    """An Arrow column of lists of one length as rows."""
    lists = lists.combine_chunks() if isinstance(lists, pa.ChunkedArray) else lists
    n = len(lists)
    if not n:
        return np.zeros((0, 0))
    flat = lists.flatten().to_numpy(zero_copy_only=False)
    if len(flat) % n or set(np.diff(lists.offsets.to_numpy()).tolist()) != {len(flat) // n}:
        raise ValueError("vectors of unequal length")
    return flat.reshape(n, -1)


def _unit(m: np.ndarray, metric: str) -> np.ndarray:
    return m / np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-10) if metric == "cosine" else m


def _scores(q: np.ndarray, x: np.ndarray, metric: str) -> np.ndarray:
    s = q @ x.T
    if metric == "l2":
        d = np.maximum((q * q).sum(1)[:, None] + (x * x).sum(1)[None, :] - 2 * s, 0)
        s = 1 / (1 + np.sqrt(d))
    return np.round(s, 6)


class _Best:
    """The k best keys so far of every query, ties to the smaller id; what is waiting is bounded.

    Keys are first scored in single precision, and those within ``_NEAR`` of a query's k-th best again in double."""

    def __init__(self, qi: np.ndarray, qv: np.ndarray, k: int, least: float | None, exclude_self: bool, metric: str, lsh: tuple[int, int] | None = None):
        self.qi, self.k, self.exclude_self, self.metric, self.lsh = qi, k, exclude_self, metric, lsh
        if lsh:
            self.sig = _sides(qv, *lsh)
            self.alike = [{s: np.flatnonzero(own == s) for s in np.unique(own).tolist()} for own in self.sig.T]
        self.qv = qv = _unit(qv, metric)
        self.short = qv.astype(np.float32)
        self.size = np.sqrt((qv * qv).sum(1))
        self.bar = np.full(len(qi), -np.inf if least is None else least)
        self.least = self.bar.copy()
        self.row, self.key, self.score = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
        self.new: list[tuple] = []
        self.waiting = 0

    def see(self, xv: np.ndarray, xi: np.ndarray) -> None:
        """Keys against all queries, or those that share a signature: a pair counts in the first table where it does."""
        if not len(xi) or not len(self.qi):
            return
        if xv.shape[1] != self.qv.shape[1]:
            raise ValueError("vectors of unequal length")
        if not self.lsh:
            return self.take(_unit(xv, self.metric), xi)
        sig, unit = _sides(xv, *self.lsh), _unit(xv, self.metric)
        for t, alike in enumerate(self.alike):
            for s in np.unique(sig[:, t]).tolist():
                if s in alike:
                    own = np.flatnonzero(sig[:, t] == s)
                    self.take(unit[own], xi[own], alike[s], lambda row, col: (self.sig[row, :t] != sig[own[col], :t]).all(1))  # noqa: B023

    def take(self, xv: np.ndarray, xi: np.ndarray, rows: np.ndarray | None = None, keep=None) -> None:
        """Keys against all queries, or those at ``rows``; ``keep`` (row, col) says which of the pairs found count."""
        size = np.sqrt((xv * xv).sum(1))
        wide = self.size.max(initial=0) + size.max(initial=0) > 1e12  # its squares would leave single precision
        mine, short, near = (self.qv, xv, _NEAR) if wide else (self.short, xv.astype(np.float32), max(_NEAR, 2e-7 * xv.shape[1]))
        every = np.arange(len(self.qi)) if rows is None else rows
        for qa in range(0, len(every), TILE_ROWS):
            own = every[qa : qa + TILE_ROWS]
            for xa in range(0, len(xi), TILE_ROWS):
                s = mine[own] @ short[xa : xa + TILE_ROWS].T
                if self.metric == "l2":  # 1 / (1 + d) >= bar where d <= 1 / bar - 1, so half of the square is bounded
                    with np.errstate(divide="ignore", invalid="ignore"):
                        far = np.where(self.bar[own] > near, 1 / np.maximum(self.bar[own] - near, 1e-300) - 1, np.inf)
                    s -= (size[xa : xa + TILE_ROWS] ** 2 / 2)[None, :].astype(s.dtype)
                    slack = near * (1 + self.size[own] ** 2 + size[xa : xa + TILE_ROWS].max() ** 2)
                    bound = self.size[own] ** 2 / 2 - far * far / 2 - slack
                else:
                    bound = self.bar[own] - near * np.maximum(1, self.size[own] * size[xa : xa + TILE_ROWS].max())
                bound = np.nextafter(bound.astype(s.dtype), s.dtype.type(-np.inf))
                if s.shape[1] > 4 * self.k:  # the tile's own k-th best bounds it as well, while there is no bar
                    none = np.flatnonzero(np.isneginf(self.bar[own])) if keep is None and not self.exclude_self else np.zeros(0, int)
                    if len(none):
                        at = np.partition(s[none], s.shape[1] - self.k, axis=1)[:, s.shape[1] - self.k]
                        room = slack[none] if self.metric == "l2" else near * np.maximum(1, self.size[own[none]] * size[xa : xa + TILE_ROWS].max())
                        bound[none] = np.maximum(bound[none], np.nextafter((at - 2 * room).astype(s.dtype), s.dtype.type(-np.inf)))
                row, col = np.divmod(np.flatnonzero(s >= bound[:, None]), s.shape[1])
                row, col = own[row], col + xa
                if self.exclude_self:
                    other = self.qi[row] != xi[col]
                    row, col = row[other], col[other]
                if keep is not None and len(row):
                    kept = keep(row, col)
                    row, col = row[kept], col[kept]
                for at in range(0, len(row), PAIR_ROWS):
                    self._add(row[at : at + PAIR_ROWS], col[at : at + PAIR_ROWS], xv, xi)

    def _add(self, row: np.ndarray, col: np.ndarray, xv: np.ndarray, xi: np.ndarray) -> None:
        if self.metric == "l2":
            d = self.qv[row] - xv[col]
            s = np.round(1 / (1 + np.sqrt(np.einsum("nw,nw->n", d, d))), 6)
        else:
            s = np.round(np.einsum("nw,nw->n", self.qv[row], xv[col]), 6)
        good = s >= self.bar[row]
        self.new.append((row[good], xi[col[good]], s[good]))
        self.waiting += int(good.sum())
        if self.waiting > max(WAITING_ROWS, len(self.row) // 2):
            self.settle()

    def settle(self) -> None:
        if not self.new:
            return
        row, key, score = (np.concatenate(c) for c in zip((self.row, self.key, self.score), *self.new))
        order = np.lexsort((key, -score, row))
        row, key, score = row[order], key[order], score[order]
        nth = np.arange(len(row)) - np.searchsorted(row, row)
        self.bar = self.least.copy()
        last = nth == self.k - 1
        self.bar[row[last]] = np.maximum(self.bar[row[last]], score[last])
        kept = nth < self.k
        self.row, self.key, self.score, self.new, self.waiting = row[kept], key[kept], score[kept], [], 0

    def batches(self):
        self.settle()
        for at in range(0, len(self.row), OUT_ROWS):
            cut = slice(at, at + OUT_ROWS)
            yield pa.RecordBatch.from_arrays([pa.array(self.qi[self.row[cut]]), pa.array(self.key[cut]), pa.array(self.score[cut])], names=["query_id", "key_id", "score"])


def knn_join(queries: DataFrame, keys: DataFrame, k: int, least: float | None = None, exclude_self: bool = False, id_col: str = "vec_id", vec_col: str = "embedding", metric: str = "cosine", broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """(``query_id``, ``rank``, ``key_id``, ``score``): the k keys of the highest score for every query.

    Every worker scores its keys against all queries, a matrix product a tile, and hands on k rows a query; queries whose
    vectors and results are too large for that are dealt out to the workers in groups, which all keys pass by.
    ``metric``: cosine, ip, or l2 (1 / (1 + distance))."""
    q, x = _usable(queries, id_col, vec_col), _usable(keys, id_col, vec_col)
    return _ranked(_nearest(q, x, k, least, exclude_self, metric, None, broadcast_bytes), k)


def _ranked(found: DataFrame, k: int) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "key_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "key_id", "score")


def _nearest(q: DataFrame, x: DataFrame, k: int, least: float | None, exclude_self: bool, metric: str, lsh: tuple[int, int] | None, broadcast_bytes: int) -> DataFrame:
    """k rows or more a query."""
    n, width = q.agg(F.count("*"), F.max(F.size("v"))).first()
    parts = x.sparkSession.sparkContext.defaultParallelism
    state = 8 * n * ((width or 0) + 3 * k)  # a query's vector, and what is kept for it
    if state > broadcast_bytes:
        return _in_groups(q, x, k, least, exclude_self, metric, lsh, max(parts, -(-state // GROUP_BYTES)))
    rows = q.orderBy("id").toArrow()  # no more than broadcast_bytes
    shared = q.sparkSession.sparkContext.broadcast((rows.column("id").to_numpy(), _matrix(rows.column("v"))))

    def run(batches):
        best = _Best(*shared.value, k, least, exclude_self, metric, lsh)
        for b in batches:
            best.see(_matrix(b.column(1)), b.column(0).to_numpy())
        yield from best.batches()

    return x.repartition(parts, "id").mapInArrow(run, _FOUND)


def _in_groups(q: DataFrame, x: DataFrame, k: int, least, exclude_self: bool, metric: str, lsh, groups: int) -> DataFrame:
    """Groups of queries, each of which meets all keys in one task; keys go to every group in blocks of ``BLOCK_ROWS``."""

    def packed(df: DataFrame) -> DataFrame:
        def run(batches):
            for b in batches:
                for at in range(0, b.num_rows, BLOCK_ROWS):
                    part = b.slice(at, BLOCK_ROWS)
                    yield pa.RecordBatch.from_arrays([pa.array([part.column(0).to_numpy().astype(np.int64).tobytes()], pa.binary()), pa.array([_matrix(part.column(1)).tobytes()], pa.binary())], names=["i", "v"])

        return df.mapInArrow(run, "i binary, v binary")

    def pack_queries(batches):
        for b in batches:
            group = b.column(2).to_numpy()
            i, m = b.column(0).to_numpy().astype(np.int64), _matrix(b.column(1))
            for g in np.unique(group):
                yield pa.RecordBatch.from_arrays([pa.array([g], pa.int32()), pa.array([0], pa.int32()), pa.array([i[group == g].tobytes()], pa.binary()), pa.array([m[group == g].tobytes()], pa.binary())], names=["g", "side", "i", "v"])

    def run(batches):
        qs: dict[int, list] = {}
        now, best = None, None
        for b in batches:
            for g, side, i, v in zip(*(c.to_pylist() for c in b.columns)):
                i = np.frombuffer(i, np.int64)
                v = np.frombuffer(v).reshape(len(i), -1)
                if not side:
                    qs.setdefault(g, []).append((i, v))
                elif g in qs or g == now:
                    if g != now:
                        if best:
                            yield from best.batches()
                        qi, qv = (np.concatenate(c) for c in zip(*qs.pop(g)))
                        now, best = g, _Best(qi, qv, k, least, exclude_self, metric, lsh)
                    best.see(v, i)
        if best:
            yield from best.batches()

    dealt = q.select("id", "v", F.pmod(F.xxhash64("id"), F.lit(groups)).cast("int").alias("g")).mapInArrow(pack_queries, "g int, side int, i binary, v binary")
    spread = packed(x).select(F.explode(F.sequence(F.lit(0), F.lit(groups - 1))).alias("g"), F.lit(1).alias("side"), "i", "v")
    return dealt.unionByName(spread).repartitionById(groups, "g").sortWithinPartitions("g", "side").mapInArrow(run, _FOUND)


def search(queries: DataFrame, store: DataFrame, k: int, filters: dict | None = None, least: float | None = None, id_col: str = "vec_id", vec_col: str = "embedding", metric: str = "cosine") -> DataFrame:
    """Top k of the rows whose columns equal ``filters``; the filter comes first, so k rows are found where there are k."""
    for c, value in (filters or {}).items():
        store = store.where(F.col(c).eqNullSafe(F.lit(value)))
    return knn_join(queries, store, k, least, id_col=id_col, vec_col=vec_col, metric=metric)


def planes(tables: int, bits: int, width: int) -> np.ndarray:
    """Hyperplanes (tables, bits, width) by a formula that SQL can repeat."""
    t, b, w = np.ogrid[:tables, :bits, :width]
    return ((t * 7919 + b * 104729 + w * 1299709 + 12345) * 48271 % 2147483647 % 10007) / 5003.0 - 1.0


def _sides(m: np.ndarray, tables: int, bits: int) -> np.ndarray:
    """Signatures (vectors, tables)."""
    up = (m @ planes(tables, bits, m.shape[1]).reshape(tables * bits, -1).T > 0).reshape(len(m), tables, bits)
    return (up * (1 << np.arange(bits, dtype=np.int64))).sum(2)


def signatures(df: DataFrame, tables: int, bits: int, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """(``id``, ``tab``, ``sig``): on which sides of each table's planes a vector lies (on a plane counts as below)."""

    def run(batches):
        for b in batches:
            if not b.num_rows:
                continue
            sig = _sides(_matrix(b.column(1)), tables, bits)
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(b.column(0).to_numpy(), tables)), pa.array(np.tile(np.arange(tables, dtype=np.int32), b.num_rows)), pa.array(sig.ravel())], names=["id", "tab", "sig"])

    return _usable(df, id_col, vec_col).mapInArrow(run, "id long, tab int, sig long")


def lsh_join(queries: DataFrame, keys: DataFrame, k: int, tables: int = 8, bits: int = 16, id_col: str = "vec_id", vec_col: str = "embedding", broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """Like :func:`knn_join` by cosine, among the keys that share a signature with the query in any table; queries without such a key are answered exactly."""
    q, x = _usable(queries, id_col, vec_col), _usable(keys, id_col, vec_col)
    near = written(_ranked(_nearest(q, x, k, None, False, "cosine", (tables, bits), broadcast_bytes), k), "near")  # k rows a query
    lonely = q.join(near.select(F.col("query_id").alias("id")).distinct(), "id", "left_anti")
    return near.unionByName(knn_join(lonely, x, k, id_col="id", vec_col="v"))


def two_step_join(queries: DataFrame, keys: DataFrame, k: int, coarse_k: int = 100, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """The ``coarse_k`` keys of the highest dot product, and of these the k best."""
    coarse = knn_join(queries, keys, max(k, coarse_k), id_col=id_col, vec_col=vec_col, metric="ip")
    return coarse.where(F.col("rank") <= k)


def synonym_edges(entities: DataFrame, k: int = 101, least: float = 0.8, text_col: str | None = None, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """(``src``, ``dst``, ``weight``): for every entity its up to ``k`` neighbours of at least ``least``, itself left out; with
    ``text_col``, entities of two or fewer ASCII letters and digits don't ask, and empty phrases are no partners."""
    asking, asked = entities, entities
    if text_col:
        asking = entities.where(F.length(F.regexp_replace(text_col, "[^A-Za-z0-9]", "")) > 2)
        asked = entities.where(F.col(text_col) != "")
    return knn_join(asking, asked, k, least, exclude_self=True, id_col=id_col, vec_col=vec_col).select(F.col("query_id").alias("src"), F.col("key_id").alias("dst"), F.col("score").alias("weight"))
