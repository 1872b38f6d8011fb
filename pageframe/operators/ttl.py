"""Hit or miss of every request under a time-to-live store.

The first request of a key is a miss; a later one is a miss when it comes more
than ``ttl`` after the last miss.  Each miss depends on the one before, so a key
is a sequential chain:

* An ordinary key is folded in order within one row.
* A key with more distinct times than ``max_group`` is cut into time chunks.
  What a chunk does to the chain is a step function from "last miss before" to
  "last miss after".  Chunks build their functions in parallel, the functions
  are composed by prefix doubling (log2 of the chunk count), and then every
  chunk marks its own misses.  No task sees more than one chunk of a key.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pageframe.sources.shared import cut_lineage

MAX_GROUP = 200_000
_NEVER = -(2**62)   # last miss of a key that has none
_SAME = -(2**63)    # marks the step where a function returns its input


def ttl_hits(
    log: DataFrame,
    ttl_ms: int,
    key: str = "cache_key",
    ts: str = "ts_ms",
    order: str = "request_id",
    seed: DataFrame | None = None,
    max_group: int = MAX_GROUP,
) -> DataFrame:
    """``log`` plus ``is_miss``.

    ``seed`` is ``(key, last_set)`` from an earlier run.  Of several requests
    of a key at the same millisecond the lowest ``order`` is the candidate.
    """
    misses = miss_times(log, ttl_ms, key, ts, seed, max_group)
    candidates = log.groupBy(key, ts).agg(F.min(order).alias("_first"))
    marked = candidates.join(misses, [key, ts], "left_semi").select(
        F.col("_first").alias(order), F.lit(True).alias("_miss")
    )
    return log.join(marked, order, "left").withColumn(
        "is_miss", F.coalesce("_miss", F.lit(False))
    ).drop("_miss")


def miss_times(
    log: DataFrame,
    ttl_ms: int,
    key: str = "cache_key",
    ts: str = "ts_ms",
    seed: DataFrame | None = None,
    max_group: int = MAX_GROUP,
) -> DataFrame:
    """``(key, ts)`` of every miss."""
    # equal times of a key collapse before the shuffle
    stamps = log.select(F.col(key).alias("k"), F.col(ts).alias("t")).distinct()
    hot = stamps.groupBy("k").count().where(F.col("count") > max_group).select("k")
    seeds = None if seed is None else seed.select(F.col(key).alias("k"), "last_set")
    if hot.isEmpty():
        out = _fold(stamps, seeds, ttl_ms)
    else:
        # each hot key owns more than max_group rows: one key in so many rows at most
        cold = stamps.join(F.broadcast(hot), "k", "left_anti")
        big = stamps.join(F.broadcast(hot), "k", "left_semi")
        out = _fold(cold, seeds, ttl_ms).unionByName(_chunked(big, seeds, ttl_ms, max_group))
    return out.select(F.col("k").alias(key), F.col("t").alias(ts))


def _fold(stamps: DataFrame, seeds: DataFrame | None, ttl_ms: int) -> DataFrame:
    grouped = stamps.groupBy("k").agg(F.sort_array(F.collect_list("t")).alias("times"))
    if seeds is not None:
        grouped = grouped.join(seeds, "k", "left")
    else:
        grouped = grouped.withColumn("last_set", F.lit(None).cast("bigint"))

    @F.pandas_udf("array<bigint>")
    def chain(times: pd.Series, last: pd.Series) -> pd.Series:
        return pd.Series([_walk(np.asarray(t), _start(s), ttl_ms) for t, s in zip(times, last)])

    return grouped.select("k", F.explode(chain("times", "last_set")).alias("t"))


def _start(value) -> int:
    return _NEVER if value is None or pd.isna(value) else int(value)


def _walk(times: np.ndarray, last: int, ttl: int) -> np.ndarray:
    """Misses among sorted times, one search per miss."""
    found = []
    at = int(np.searchsorted(times, last + ttl, "right"))
    while at < len(times):
        found.append(int(times[at]))
        at = int(np.searchsorted(times, times[at] + ttl, "right"))
    return np.asarray(found, dtype="int64")


def _chunk_function(times: np.ndarray, ttl: int) -> tuple[np.ndarray, np.ndarray]:
    """Step function (starts, exits) of one chunk of sorted times."""
    n = len(times)
    jump = np.searchsorted(times, times + ttl, "right")
    ends = np.append(np.arange(n), n)
    hop = np.append(jump, n)
    ends = np.where(hop == n, ends, hop)
    # pointer jumping: follow the chain of every possible first miss at once
    while True:
        nxt = ends[ends]
        if np.array_equal(nxt, ends):
            break
        ends = nxt
    starts = np.concatenate([[_NEVER], times - ttl])
    exits = np.append(times[ends[:n]], _SAME)
    return _squeeze(starts, exits)


def _squeeze(starts: np.ndarray, exits: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    keep = np.append(True, exits[1:] != exits[:-1])
    return starts[keep], exits[keep]


def _apply(starts: np.ndarray, exits: np.ndarray, at: np.ndarray) -> np.ndarray:
    value = exits[np.searchsorted(starts, at, "right") - 1]
    return np.where(value == _SAME, at, value)


def _compose(a: tuple, b: tuple) -> tuple[np.ndarray, np.ndarray]:
    """First ``a``, then ``b``; only the last step of ``a`` can be the identity."""
    (sa, ea), (sb, eb) = a, b
    fixed = ea != _SAME
    starts, exits = [sa[fixed]], [_apply(sb, eb, ea[fixed])]
    if not fixed[-1]:
        edge = sa[-1]
        inner = sb > edge
        first = eb[np.searchsorted(sb, edge, "right") - 1]
        starts.append(np.concatenate([[edge], sb[inner]]))
        exits.append(np.concatenate([[first], eb[inner]]))
    return _squeeze(np.concatenate(starts), np.concatenate(exits))


def _chunked(
    stamps: DataFrame, seeds: DataFrame | None, ttl_ms: int, max_group: int
) -> DataFrame:
    # times are distinct milliseconds, so the span of a chunk bounds its row count
    span = max(ttl_ms, max_group)
    chunked = stamps.withColumn("c", F.floor(F.col("t") / span).cast("bigint"))

    def build(pdf: pd.DataFrame) -> pd.DataFrame:
        times = np.sort(pdf["t"].to_numpy(dtype="int64"))
        starts, exits = _chunk_function(times, ttl_ms)
        return pd.DataFrame(
            {"k": [pdf["k"].iloc[0]], "c": [pdf["c"].iloc[0]], "starts": [starts], "exits": [exits]}
        )

    kind = stamps.schema["k"].dataType.simpleString()
    fields = f"k {kind}, c bigint, starts array<bigint>, exits array<bigint>"
    functions = chunked.groupBy("k", "c").applyInPandas(build, fields)
    # number the non-empty chunks of a key; only (k, c) pairs meet here
    w = Window.partitionBy("k").orderBy("c")
    numbers = chunked.select("k", "c").distinct().withColumn("i", F.row_number().over(w))
    prefix = cut_lineage(functions.join(numbers, ["k", "c"]))
    longest = prefix.agg(F.max("i")).head()[0]

    @F.pandas_udf("struct<starts: array<bigint>, exits: array<bigint>>")
    def join(sa: pd.Series, ea: pd.Series, sb: pd.Series, eb: pd.Series) -> pd.DataFrame:
        rows = []
        for s1, e1, s2, e2 in zip(sa, ea, sb, eb):
            rows.append(
                (s2, e2) if s1 is None else _compose((np.asarray(s1), np.asarray(e1)), (np.asarray(s2), np.asarray(e2)))
            )
        return pd.DataFrame({"starts": [r[0] for r in rows], "exits": [r[1] for r in rows]})

    reach = 1
    while reach < longest:
        earlier = prefix.select(
            "k",
            (F.col("i") + reach).alias("i"),
            F.col("starts").alias("sa"),
            F.col("exits").alias("ea"),
        )
        prefix = cut_lineage(
            prefix.join(earlier, ["k", "i"], "left")
            .withColumn("f", join("sa", "ea", "starts", "exits"))
            .select("k", "c", "i", "f.starts", "f.exits")
        )
        reach *= 2

    seeded = prefix.withColumn("s", F.lit(None).cast("bigint")) if seeds is None else (
        prefix.join(seeds.withColumnRenamed("last_set", "s"), "k", "left")
    )

    @F.pandas_udf("bigint")
    def leave(starts: pd.Series, exits: pd.Series, s: pd.Series) -> pd.Series:
        return pd.Series(
            [
                int(_apply(np.asarray(a), np.asarray(b), np.asarray([_start(x)]))[0])
                for a, b, x in zip(starts, exits, s)
            ]
        )

    left = seeded.select("k", (F.col("i") + 1).alias("i"), leave("starts", "exits", "s").alias("enter"))
    first = numbers.where(F.col("i") == 1).select("k", "i")
    if seeds is None:
        begin = first.withColumn("enter", F.lit(_NEVER).cast("bigint"))
    else:
        begin = first.join(seeds, "k", "left").select(
            "k", "i", F.coalesce("last_set", F.lit(_NEVER)).cast("bigint").alias("enter")
        )
    entry = numbers.join(left.unionByName(begin), ["k", "i"]).select("k", "c", "enter")

    def mark(pdf: pd.DataFrame) -> pd.DataFrame:
        times = np.sort(pdf["t"].to_numpy(dtype="int64"))
        found = _walk(times, int(pdf["enter"].iloc[0]), ttl_ms)
        return pd.DataFrame({"k": [pdf["k"].iloc[0]] * len(found), "t": found})

    return (
        chunked.join(entry, ["k", "c"])
        .groupBy("k", "c")
        .applyInPandas(mark, f"k {kind}, t bigint")
    )


def last_sets(misses: DataFrame, seed: DataFrame | None = None, key: str = "cache_key",
              ts: str = "ts_ms") -> DataFrame:
    """``(key, last_set)`` after a run: the state of the next one."""
    sets = misses.select(key, F.col(ts).alias("last_set"))
    if seed is not None:
        sets = sets.unionByName(seed.select(key, "last_set"))
    return sets.groupBy(key).agg(F.max("last_set").alias("last_set"))
