"""BPE encoding and decoding by a pair occurrence index.

All distinct new words of an Arrow batch are laid out in one array of symbols.
The index maps each pair of neighbouring symbols to all of its positions; active
ranks are taken in ascending order from a heap, all positions of a rank are
merged, and only the lists of the pairs that a merge makes are updated.  Pairs
never cross a word, and words are independent, so the result is that of merging
each word by itself.  Word results are kept in a bounded memo.

The vocabulary file (base64 token and rank per line) is read where the work is
done; its path, the same on every node, is a parameter.

Defined results
---------------
* null text: null ids, ``n_tokens`` 0, ``round_trip`` true; empty text: no ids;
* text of any length is encoded whole; equal texts have equal ids;
* every byte sequence can be encoded (lone surrogates are replaced by U+FFFD
  before encoding, and ``round_trip`` is then false);
* an empty table gives an empty result; only id, text and the columns to keep are read.
"""

from __future__ import annotations

import base64
import heapq

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import types as T

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def read_ranks(path: str = VOCABULARY) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


class Bpe:
    """Encoder and decoder of one vocabulary; the memo keeps up to ``most`` words, as places in one array of ids."""

    def __init__(self, ranks: dict[bytes, int], pattern: str = PATTERN, most: int = 200_000):
        self.ranks, self.most = ranks, most
        self.forget()
        self.find = regex.compile(pattern).findall
        self.bytes = {i: b for b, i in ranks.items()}
        self.byte_id = np.array([ranks[bytes([i])] for i in range(256)], np.int64)
        self.width = max(ranks.values()) + 1
        keys = [(ranks[t[:k]] * self.width + ranks[t[k:]], r) for t, r in ranks.items() for k in range(1, len(t)) if t[:k] in ranks and t[k:] in ranks]
        self.pairs = dict(keys)  # left * width + right -> id of what they make, which is the merge's rank
        self.keys = np.array(sorted(self.pairs), np.int64)
        self.made = np.array([self.pairs[k] for k in self.keys.tolist()], np.int64)

        known = sorted(self.bytes)
        self.size = np.zeros(self.width, np.int32)
        self.size[known] = [len(self.bytes[i]) for i in known]
        self.place = np.zeros(self.width, np.int32)
        self.place[known] = np.cumsum(self.size[known]) - self.size[known]
        # the last place stands for ids that the vocabulary lacks
        self.size, self.place = np.append(self.size, np.int32(3)), np.append(self.place, np.int32(self.size.sum()))
        self.letters = np.frombuffer(b"".join([*(self.bytes[i] for i in known), "\ufffd".encode()]), np.uint8)
        self.lacking = np.append(self.size[:-1] == 0, True)

    def forget(self) -> None:
        self.memo: dict[str, int] = {}
        self.flat, self.begin, self.count = (np.zeros(0, np.int32) for _ in range(3))

    def rank_of(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Rank of the merge of each two symbols; -1 for none."""
        k = a * self.width + b
        at = np.minimum(np.searchsorted(self.keys, k), len(self.keys) - 1)
        return np.where(self.keys[at] == k, self.made[at], -1)

    def merge_all(self, raw: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The pair occurrence index over many words at once: all ids, and how many each word has."""
        size = np.fromiter(map(len, raw), np.int64, len(raw))
        sym = self.byte_id[np.frombuffer(b"".join(raw), np.uint8)]
        word = np.repeat(np.arange(len(raw)), size)
        n = len(sym)
        nxt, prv = np.arange(1, n + 1), np.arange(-1, n - 1)
        last = np.cumsum(size) - 1
        nxt[last], prv[last - size + 1] = -1, -1
        index: dict[int, list[np.ndarray]] = {}
        active: list[int] = []

        def enter(at: np.ndarray) -> None:
            r = self.rank_of(sym[at], sym[nxt[at]])
            at, r = at[r >= 0], r[r >= 0]
            order = np.argsort(r, kind="stable")
            at, r = at[order], r[order]
            cuts = np.flatnonzero(r[1:] != r[:-1]) + 1
            begin = [0, *cuts.tolist()] if len(r) else []
            for s, e, k in zip(begin, [*begin[1:], len(r)], r[begin].tolist() if begin else []):
                if k in index:
                    index[k].append(at[s:e])
                else:
                    index[k] = [at[s:e]]
                    heapq.heappush(active, k)

        enter(np.flatnonzero(nxt >= 0))
        while active:
            rank = heapq.heappop(active)
            lists = index.pop(rank)
            at = lists[0] if len(lists) == 1 else np.concatenate(lists)
            at = at[(sym[at] >= 0) & (nxt[at] >= 0)]
            at = at[self.rank_of(sym[at], sym[nxt[at]]) == rank]  # the others were merged elsewhere meanwhile
            if not len(at):
                continue
            every = at = np.unique(at)
            if len(at) > 1:
                # of positions that follow each other at once, as in a run of one letter, every other one
                run = np.concatenate([[True], nxt[at[:-1]] != at[1:]])
                number = np.arange(len(at))
                at = at[(number - np.maximum.accumulate(np.where(run, number, 0))) % 2 == 0]
            gone = nxt[at]
            left, after = prv[at], nxt[gone]
            # from left to right in a word, until a merge makes a pair that comes before this one
            merged = np.concatenate([[False], gone[:-1] == left[1:]])
            before = np.where(left >= 0, self.rank_of(np.where(merged, rank, sym[left]), np.full(len(at), rank)), -1)
            behind = np.where(after >= 0, self.rank_of(np.full(len(at), rank), sym[after]), -1)
            lower = ((before >= 0) & (before < rank)) | ((behind >= 0) & (behind < rank))
            if lower.any():
                w = word[at]
                stop = np.unique(w[lower], return_index=True)
                ends = np.full(len(at), len(at))
                k = np.minimum(np.searchsorted(stop[0], w), len(stop[0]) - 1)
                own = stop[0][k] == w
                ends[own] = np.flatnonzero(lower)[stop[1]][k[own]]
                now = np.arange(len(at)) <= ends
                if not now.all():
                    index[rank] = [np.setdiff1d(every, at[now], assume_unique=True)]
                    heapq.heappush(active, rank)
                    at, gone, after = at[now], gone[now], after[now]
            sym[at], sym[gone] = rank, -1
            nxt[at] = after
            prv[after[after >= 0]] = at[after >= 0]
            left = prv[at]
            enter(np.concatenate([left[left >= 0], at[after >= 0]]))
        kept = sym >= 0
        counts = np.bincount(word[kept], minlength=len(raw))
        return sym[kept], counts

    def learn(self, new: list[str]) -> None:
        """Encodes distinct words together and puts their ids into the memo."""
        words, raws, single, singles = [], [], [], []
        for w in new:
            raw = w.encode("utf-8")
            if (known := self.ranks.get(raw)) is not None:
                single.append(w)
                singles.append(known)
            else:
                words.append(w)
                raws.append(raw)
        flat, count = self.merge_all(raws) if words else (np.zeros(0, np.int32), np.zeros(0, np.int32))
        flat = np.concatenate([flat, np.asarray(singles, np.int64)]).astype(np.int32)
        count = np.concatenate([count, np.ones(len(single), np.int64)]).astype(np.int32)
        self.memo.update(zip([*words, *single], range(len(self.memo), len(self.memo) + len(count))))
        self.begin = np.concatenate([self.begin, (np.cumsum(count) - count + len(self.flat)).astype(np.int32)])
        self.flat, self.count = np.concatenate([self.flat, flat]), np.concatenate([self.count, count])

    def encode_flat(self, texts: list) -> tuple[np.ndarray, np.ndarray]:
        """All ids of all texts, and where each text ends (with a zero before)."""
        pieces = [self.find(t) if t else [] for t in texts]
        if len(self.memo) > self.most:
            self.forget()
        new: set = set()
        for p in pieces:
            new.update(p)
        new.difference_update(self.memo)
        self.learn(list(new))
        get = self.memo.__getitem__
        at = np.fromiter((x for p in pieces for x in map(get, p)), np.int32, sum(map(len, pieces)))
        ends = np.concatenate([[0], np.cumsum(np.fromiter(map(len, pieces), np.int64, len(pieces)))])
        count = self.count[at]
        total = np.concatenate([[0], np.cumsum(count, dtype=np.int64)])
        ids = self.flat[_spread(self.begin[at], count)]
        return ids, total[ends]

    def encode_batch(self, texts: list) -> list:
        """Ids of each text; None for None."""
        ids, ends = self.encode_flat(texts)
        return [None if t is None else ids[s:e].tolist() for t, s, e in zip(texts, ends, ends[1:])]

    def decode_flat(self, ids: np.ndarray, ends: np.ndarray) -> tuple[bytes, np.ndarray]:
        """The bytes of all texts, and where each text ends (with a zero before)."""
        ids = np.where((ids >= 0) & (ids < self.width), ids, self.width)
        ids = np.where(self.lacking[ids], self.width, ids)
        size = self.size[ids]
        total = np.concatenate([[0], np.cumsum(size, dtype=np.int64)])
        return self.letters[_spread(self.place[ids], size)].tobytes(), total[ends]


def _spread(begin: np.ndarray, count: np.ndarray) -> np.ndarray:
    """begin[0], begin[0] + 1, ... for count[0] numbers, then begin[1], ..."""
    ends = np.cumsum(count, dtype=np.int64)
    n = int(ends[-1]) if len(ends) else 0
    kind = np.int32 if n < 1 << 31 else np.int64
    return np.repeat((begin - (ends - count)).astype(kind), count) + np.arange(n, dtype=kind)


_MADE: dict = {}


def made(path: str) -> Bpe:
    if path not in _MADE:
        _MADE[path] = Bpe(read_ranks(path))
    return _MADE[path]


def _slices(batch: pa.RecordBatch, most: int = 2_000_000):
    """Runs of rows with about that many bytes of text, and at least one row each."""
    size = np.cumsum(pc.fill_null(pc.binary_length(batch.column(1)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    at = 0
    while at < batch.num_rows:
        end = max(at + 1, int(np.searchsorted(size, (size[at - 1] if at else 0) + most, "right")))
        yield batch.slice(at, end - at)
        at = end


def _plain(t):
    return t if t is None or t.isascii() else t.encode("utf-8", "replace").decode("utf-8")


def encode_documents(docs: DataFrame, path: str = VOCABULARY, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """(id, ``token_ids``, ``n_tokens``, ``round_trip``, the columns ``keep``): the ids are decoded again and compared with the text."""
    kind = docs.schema[id_col].dataType
    schema = T.StructType([T.StructField(id_col, kind), T.StructField("token_ids", T.ArrayType(T.IntegerType())), T.StructField("n_tokens", T.IntegerType()), T.StructField("round_trip", T.BooleanType()), *(T.StructField(c, docs.schema[c].dataType) for c in keep)])

    def run(batches):
        bpe = made(path)
        for batch in batches:
            for part in _slices(batch):
                texts = part.column(1).to_pylist()
                ids, ends = bpe.encode_flat([_plain(t) for t in texts])
                back, cuts = bpe.decode_flat(ids, ends)
                same = [t is None or back[s:e] == t.encode("utf-8", "surrogatepass") for t, s, e in zip(texts, cuts.tolist(), cuts[1:].tolist())]
                lists = pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(ids, pa.int32()), mask=pa.array([t is None for t in texts], pa.bool_()))
                yield pa.RecordBatch.from_arrays([part.column(0), lists, pa.array(np.diff(ends).astype(np.int32)), pa.array(same, pa.bool_()), *part.columns[2:]], names=schema.names)

        bpe.forget()

    return docs.select(id_col, text_col, *keep).mapInArrow(run, schema)


def decode_documents(encoded: DataFrame, path: str = VOCABULARY, id_col: str = "doc_id", ids_col: str = "token_ids") -> DataFrame:
    """(id, ``text``) from ids; null for null, and U+FFFD for a null or unknown id and for bytes that aren't UTF-8."""
    kind = encoded.schema[id_col].dataType
    schema = T.StructType([T.StructField(id_col, kind), T.StructField("text", T.StringType())])

    def run(batches):
        bpe = made(path)
        for batch in batches:
            lists = batch.column(1)
            ids = pc.fill_null(pc.list_flatten(lists), -1).to_numpy(zero_copy_only=False).astype(np.int64)
            ends = np.concatenate([[0], np.cumsum(pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False).astype(np.int64))])
            raw, cuts = bpe.decode_flat(ids, ends)
            texts = [raw[s:e].decode("utf-8", "replace") if there else None for s, e, there in zip(cuts.tolist(), cuts[1:].tolist(), lists.is_valid().to_pylist())]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=schema.names)

    return encoded.select(id_col, ids_col).mapInArrow(run, schema)
