"""What a cache would have answered: least recently used, and with a time to live."""

from __future__ import annotations

from collections import OrderedDict

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docquarry.session import ship_package

# How many values a cache holds and for how many seconds a value lives.
SIZE, SECONDS = 500, 24 * 3600


class _Cache:
    """Keys with the time at which they expire; a value that is asked for and not there is put in."""

    def __init__(self, size: int | None, ttl: float | None):
        self.size, self.ttl, self.kept = size, ttl, OrderedDict()

    def ask(self, key, at: float) -> bool:
        expires = self.kept.get(key)
        if expires is not None and (self.ttl is None or at < expires):
            if self.ttl is None:
                self.kept.move_to_end(key)
            return True
        self.kept.pop(key, None)
        if self.size is not None and len(self.kept) >= self.size and self.ttl is not None:
            for old in [k for k, e in self.kept.items() if e <= at]:
                del self.kept[old]
        # the first is the one used longest ago, or with a time to live the one that expires first
        while self.size is not None and len(self.kept) >= self.size:
            self.kept.popitem(last=False)
        self.kept[key] = at + (self.ttl or 0)
        return False


def cache_hits(asked: DataFrame, size: int | None = SIZE, ttl: float | None = None) -> DataFrame:
    """(cache, ask_id, hit) of asked (cache, key, ask_id, ts): whether a cache had the value when it was asked for.

    A cache starts empty and takes in every value that it misses. With a ttl, in seconds, a value lives so long from
    then, and a full cache drops what has expired, then what expires first; without one it drops what was used
    longest ago. Questions of a cache are taken in the order of ts and ask_id, sorted by Spark within partitions of
    caches and folded as they stream by: a task holds one cache at a time, of `size` keys at most. One cache is one
    sequence, so its questions stay together. Null keys are a key; null caches are a cache.
    """
    if size is None and ttl is None:
        raise ValueError("a cache needs a size or a time to live")
    ship_package(asked.sparkSession)
    rows = asked.selectExpr("cast(cache as string) cache", "cast(key as string) key", "ask_id", "unix_micros(cast(ts as timestamp)) / 1e6D at")
    rows = rows.repartition("cache").sortWithinPartitions("cache", "at", "ask_id")

    def fold(batches):
        now, cache = None, None
        for batch in batches:
            hits = []
            for name, key, at in zip(*(batch.column(k).to_pylist() for k in (0, 1, 3))):
                if cache is None or name != now:
                    now, cache = name, _Cache(size, ttl)
                hits.append(cache.ask(key, at))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(hits, pa.bool_())], ["cache", "ask_id", "hit"])

    return rows.mapInArrow(fold, "cache string, ask_id long, hit boolean")


def hit_rates(hits: DataFrame) -> DataFrame:
    """(cache, hits, misses, hit_rate) of cache_hits; the rate to three places."""
    counted = hits.groupBy("cache").agg(F.count_if("hit").alias("hits"), F.count_if(~F.col("hit")).alias("misses"))
    return counted.withColumn("hit_rate", F.round(F.col("hits") / (F.col("hits") + F.col("misses")), 3))
