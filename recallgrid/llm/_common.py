"""Helpers that several of the operators share."""

from __future__ import annotations

import re
import tempfile
import uuid
from itertools import islice

import numpy as np
import xxhash
from pyspark.sql import DataFrame, SparkSession

WORD = re.compile(r"\w+")


def words(text) -> list[str]:
    """Lower-cased words of a whole text; none for null."""
    return WORD.findall(text.lower()) if text else []


class WordHashes(dict):
    """Memo word -> 64-bit hash that forgets everything beyond ``most`` words."""

    def __init__(self, most: int = 200_000):
        super().__init__()
        self.most = most

    def __missing__(self, word: str) -> int:
        if len(self) >= self.most:  # the oldest half goes
            for w in list(islice(self, self.most // 2)):
                del self[w]
        self[word] = h = xxhash.xxh3_64_intdigest(word.encode("utf-8", "surrogatepass"))
        return h


def mix(h: np.ndarray) -> np.ndarray:
    """Finaliser that spreads every bit of a uint64 array over all bits."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h = h ^ (h >> np.uint64(27))
    h = h * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def ngram_set(text, n: int, memo: WordHashes) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the word n-grams; a text of 1 to n-1 words is one gram; none without words."""
    w = words(text)
    if not w:
        return np.zeros(0, np.uint64)
    a = np.fromiter(map(memo.__getitem__, w), np.uint64, len(w))
    n = min(n, len(a))
    h = np.full(len(a) - n + 1, n, np.uint64)
    for i in range(n):
        h = mix(h * np.uint64(0x9E3779B97F4A7C15) + a[i : len(a) - n + 1 + i])
    return np.unique(h)


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share, from ``spark.checkpoint.dir``; a temporary one only in local mode."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found
    if re.match(r"local(\[|$)", spark.sparkContext.master):
        found = "file://" + tempfile.mkdtemp(prefix="recallgrid-")
        spark.conf.set("spark.checkpoint.dir", found)
        return found
    raise ValueError("spark.checkpoint.dir must name a folder that all executors share")


def written(df: DataFrame, name: str) -> DataFrame:
    """The frame as a table written to the shared folder: cut off from its lineage, safe from lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(p)
    return spark.read.schema(df.schema).parquet(path)
