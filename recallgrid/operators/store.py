"""A keyed store as immutable tables: every change is a new frame.

Defined results: keys are compared null-safe, so a null key is a key like others;
of rows with equal new keys one is taken (the one that is least by its columns);
repeated rows of the store itself are kept; empty tables on either side are fine;
columns that only one side has are dropped (the store's schema holds).
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _keys(df: DataFrame, key: str) -> DataFrame:
    return df.select(F.col(key).alias("__key")).distinct()


def _anti(rows: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    other = _keys(keys, key)
    return rows.join(other, rows[key].eqNullSafe(other["__key"]), "left_anti")


def one_each(rows: DataFrame, key: str) -> DataFrame:
    """A row for each key: the least by its other columns (maps can't be compared and don't count)."""
    rest = [c for c, kind in rows.dtypes if c != key and not kind.startswith("map")]
    maps = [c for c, kind in rows.dtypes if kind.startswith("map")]
    if not rest:
        return rows.dropDuplicates([key])
    best = F.min_by(F.struct(*rest, *maps), F.struct(*rest)) if maps else F.min(F.struct(*rest))
    return rows.groupBy(key).agg(best.alias("__x")).select(*(F.col(c) if c == key else F.col(f"__x.{c}").alias(c) for c in rows.columns))


def missing(store: DataFrame, rows: DataFrame, key: str) -> DataFrame:
    """Distinct keys of ``rows`` that the store lacks."""
    return _anti(rows.select(key).distinct(), store, key)


def insert_if_absent(store: DataFrame, rows: DataFrame, key: str) -> DataFrame:
    """The store and those rows whose key is new."""
    return store.unionByName(one_each(_anti(rows.select(*store.columns), store, key), key))


def upsert(store: DataFrame, rows: DataFrame, key: str) -> DataFrame:
    """The store with the rows put in or in place of those of the same key."""
    return _anti(store, rows, key).unionByName(one_each(rows.select(*store.columns), key))


def delete(store: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    return _anti(store, keys, key)


def lookup(store: DataFrame, ids: DataFrame, key: str, order: str | None = None) -> DataFrame:
    """A row for each row of ``ids``, with ``found`` and the store's columns (null where it lacks the key); ``order`` carries the place."""
    keep = [c for c in store.columns if c != key]
    there = store.select(F.col(key).alias("__key"), *keep).withColumn("__there", F.lit(True))
    asked = ids.select(key, *([order] if order else []))
    return asked.join(there, asked[key].eqNullSafe(there["__key"]), "left").select(*asked.columns, F.coalesce("__there", F.lit(False)).alias("found"), *keep)


def distinct_ids(df: DataFrame, key: str) -> DataFrame:
    """(key, ``code``): dense codes from 0 in the order of the keys; numbered by place in sorted partitions, not in one task."""
    from recallgrid.operators.ranking import numbered

    return numbered(df.select(key).where(F.col(key).isNotNull()).distinct(), [key], "code")


def cascade_delete(facts: DataFrame, chunks: DataFrame) -> DataFrame:
    """(``kind``, ``id``) of all that goes with the given chunks: the chunks, facts that no other chunk states, entities
    that no other chunk mentions, and vertices (chunks and entities)."""
    gone = chunks.select(F.col("chunk").alias("__chunk")).distinct()
    marked = facts.join(gone, facts["chunk"] == gone["__chunk"], "left").withColumn("__gone", F.col("__chunk").isNotNull())
    fact = marked.groupBy("s", "p", "o").agg(F.bool_and("__gone").alias("all")).where("all").select(F.lit("fact").alias("kind"), F.concat_ws("|", "s", "p", "o").alias("id"))
    mentions = marked.select(F.explode(F.array("s", "o")).alias("entity"), "__gone").where("entity is not null")
    entity = mentions.groupBy("entity").agg(F.bool_and("__gone").alias("all")).where("all").select(F.lit("entity").alias("kind"), F.col("entity").alias("id"))
    chunk = marked.where("__gone").select(F.lit("chunk").alias("kind"), F.col("chunk").alias("id")).distinct()
    vertex = entity.unionByName(chunk).select(F.lit("vertex").alias("kind"), "id")
    return chunk.unionByName(fact).unionByName(entity).unionByName(vertex)


@dataclass
class Store:
    """A store kept as Parquet versions in one folder; every change writes a new version and then moves the pointer to it."""

    spark: SparkSession
    folder: str
    schema: str
    key: str = "id"

    def _pointer(self):
        jvm = self.spark.sparkContext._jvm
        p = jvm.org.apache.hadoop.fs.Path(f"{self.folder}/CURRENT")
        return p, p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def load(self) -> DataFrame:
        p, fs = self._pointer()
        if not fs.exists(p):
            return self.spark.createDataFrame([], self.schema)
        name = self.spark.read.text(f"{self.folder}/CURRENT").first()[0]
        return self.spark.read.schema(self.schema).parquet(f"{self.folder}/{name}")

    def save(self, df: DataFrame) -> DataFrame:
        name = f"v-{uuid.uuid4().hex}"
        df.write.parquet(f"{self.folder}/{name}")
        p, fs = self._pointer()
        out = fs.create(p, True)
        out.write(name.encode())
        out.close()
        return self.load()

    def insert(self, rows: DataFrame) -> DataFrame:
        return self.save(insert_if_absent(self.load(), rows, self.key))

    def upsert(self, rows: DataFrame) -> DataFrame:
        return self.save(upsert(self.load(), rows, self.key))

    def delete(self, keys: DataFrame) -> DataFrame:
        return self.save(delete(self.load(), keys, self.key))

    def clear(self) -> DataFrame:
        return self.save(self.spark.createDataFrame([], self.schema))

    def get(self, ids: DataFrame, order: str | None = None) -> DataFrame:
        return lookup(self.load(), ids, self.key, order)

    def ids(self) -> DataFrame:
        return self.load().select(self.key)

    def count(self) -> int:
        return self.load().count()

    __len__ = count

    def exists(self, key) -> bool:
        return self.load().where(F.col(self.key).eqNullSafe(F.lit(key))).limit(1).count() > 0
