"""Mixing sources to target weights by Pfair scheduling, in DataFrame functions only.

Each source's rows, in a fixed shuffle, form blocks. With weight w, block j (from 0) is released at slot floor(j / w) and
due by slot ceil((j + 1) / w). One block runs per slot, of the released ones that with the earliest deadline; as weights
add up to one, every block meets its deadline, so after any slot each source that still has blocks has had its weight's
share to less than one block.

Weights are whole numbers of slots in a cycle, which is made so long that rounding them moves no block of any source by
more than DRIFT blocks over the whole schedule; deviation from the target weights stays under 1 + DRIFT blocks. The plan,
one row per block, is made on the driver in parts of PLAN_ROWS rows; rows find their slots by a join on it. A source's rows
are numbered without gathering them. When a source runs out, its slots stay empty or go to blocks already released, and the
others keep their proportions; no row is left out or repeated.
"""

from __future__ import annotations

import heapq
import itertools
import json
from collections.abc import Iterable, Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from helixframe.llm.common import ranked, row_hash, shared_path, until_exit, written

#: Rows in a block, and slots in a cycle for each source, but at least so many.
BLOCK, SLOTS_PER_SOURCE, SLOTS = 32, 20, 1000
#: Blocks by which rounding a weight to whole slots may move its source until that ends, and a bound of a cycle's slots.
DRIFT, MOST_SLOTS = 0.25, 1 << 50
#: Default weights are the sources' sizes to this power.
POWER = 0.5
#: A plan of up to so many slots is broadcast; a longer one is joined by shuffling.
PLAN_ROWS = 65_536
#: Sources whose weights can be held; more is an error.
SOURCES = 100_000


def shares(weights: list[float], slots: int) -> list[int]:
    """Whole slots, at least one each, that add up to slots and are closest to the weights by largest remainder."""
    if any(not w > 0 or w == float("inf") for w in weights):
        raise ValueError("weights must be positive and finite")
    spare, total = slots - len(weights), sum(weights)
    exact = [w / total * slots for w in weights]
    own = [max(1, int(x)) for x in exact]
    order = sorted(range(len(own)), key=lambda i: (own[i] - exact[i], i))
    assert spare >= 0
    over = sum(own) - slots
    for i in range(-over):
        own[order[i % len(own)]] += 1
    above = [(exact[i] - own[i], i) for i in range(len(own)) if own[i] > 1] if over > 0 else []
    heapq.heapify(above)
    for _ in range(over):  # small sources were rounded up; those furthest above their weight give way
        _, at = heapq.heappop(above)
        own[at] -= 1
        if own[at] > 1:
            heapq.heappush(above, (exact[at] - own[at], at))
    return own


def cycle(weights: list[float], blocks: list[int]) -> list[int]:
    """The weights in whole slots of a cycle long enough for DRIFT, for sources of so many blocks.

    MOST_SLOTS bounds it, so DRIFT may be missed where a weight is below about 1e-14 for each of its source's blocks.
    """
    total, slots = sum(weights), max(SLOTS, SLOTS_PER_SOURCE * len(weights))
    while True:
        own = shares(weights, slots)
        # source i ends at about slot blocks / weight; its drift there is
        drift = max(abs(o / slots / (w / total) - 1) * n for o, w, n in zip(own, weights, blocks, strict=True))
        if drift <= DRIFT or 2 * slots > MOST_SLOTS:
            return own
        slots *= 2


def release(j: int, share: int, slots: int) -> int:
    return j * slots // share


def deadline(j: int, share: int, slots: int) -> int:
    return -(-(j + 1) * slots // share)


def turns(own: list[int], blocks: list[int]) -> Iterator[tuple[int, int, int]]:
    """(slot, source, its block) for so many blocks of each source, by earliest deadline first among released blocks."""
    slots, t = sum(own), 0
    waiting = [(0, i, 0) for i in range(len(own)) if blocks[i]]
    ready: list[tuple[int, int, int]] = []
    while waiting or ready:
        if not ready:
            t = max(t, waiting[0][0])
        while waiting and waiting[0][0] <= t:
            _, i, j = heapq.heappop(waiting)
            heapq.heappush(ready, (deadline(j, own[i], slots), i, j))
        due, i, j = heapq.heappop(ready)
        assert t < due
        yield t, i, j
        if j + 1 < blocks[i]:
            heapq.heappush(waiting, (release(j + 1, own[i], slots), i, j + 1))
        t += 1


def schedule(own: list[int]) -> list[tuple[int, int]]:
    """(source, its block) for each slot of a cycle."""
    return [(i, j) for _, i, j in turns(own, own)]


def _key(source: Column) -> Column:
    """A string for each source, with one of its own for null."""
    return F.coalesce(F.concat(F.lit("="), source.cast("string")), F.lit("null"))


def _table(spark: SparkSession, rows: Iterable[tuple[int, int, int, int]]) -> DataFrame:
    """(_turn, _slot, _of, _index) of these rows."""
    names, columns = ("_turn", "_slot", "_of", "_index"), list(zip(*rows, strict=True)) or [()] * 4
    kind = f"struct<{', '.join(f'{n}: array<bigint>' for n in names)}>"
    got = spark.range(1).select(F.from_json(F.lit(json.dumps(dict(zip(names, columns, strict=True)))), kind).alias("x"))
    return got.select(F.inline(F.arrays_zip(*(F.col(f"x.{n}") for n in names))))


def plan(spark: SparkSession, weights: dict[str, float], blocks: dict[str, int]) -> tuple[DataFrame, DataFrame, int]:
    """(_turn, _slot, _of, _index) for each block in the order they run, (_source, _number, _share) for each source, and
    the cycle's length."""
    names = sorted(weights)
    counts = [blocks[n] for n in names]
    own = cycle([weights[n] for n in names], counts)
    rows = ((k, t, i, j) for k, (t, i, j) in enumerate(turns(own, counts)))
    few = sum(counts) <= PLAN_ROWS
    if few:
        table = F.broadcast(_table(spark, rows))
    else:
        path = shared_path(spark, "plan")
        for part in itertools.batched(rows, PLAN_ROWS):
            _table(spark, part).write.mode("append").parquet(path)
        until_exit(spark, path)
        table = spark.read.parquet(path)
    said = json.dumps([{"_source": n, "_number": i, "_share": own[i]} for i, n in enumerate(names)])
    sources = spark.range(1).select(F.inline(F.from_json(F.lit(said), "array<struct<_source: string, _number: bigint, _share: bigint>>")))
    return table, (F.broadcast(sources) if len(names) <= PLAN_ROWS else sources), sum(own)


def _weights(df: DataFrame, key: Column, weights: dict[str | None, float] | None) -> tuple[dict[str, float], dict[str, int]]:
    """Weights and sizes of the sources that df has, by key."""
    sizes = df.groupBy(key.alias("k")).agg(F.count(F.lit(1)).alias("n"))
    got = {r["k"]: r["n"] for r in sizes.orderBy(F.desc("n"), "k").limit(SOURCES + 1).collect()}
    if len(got) > SOURCES:
        raise ValueError(f"more than {SOURCES} sources")
    if weights is None:
        return {k: n**POWER for k, n in got.items()}, got
    named = {"null" if k is None else f"={k}": w for k, w in weights.items()}
    least = min(named.values(), default=1.0)
    return {k: named.get(k, least) for k in got}, got


def _placed(df: DataFrame, order: list[str], weights: dict[str, float], sizes: dict[str, int], block: int) -> DataFrame:
    """df, whose column _key names the source, with weight, block, release, deadline, slot, place and _turn, the
    block's number in the order that blocks run."""
    table, sources, slots = plan(df.sparkSession, weights, {k: -(-n // block) for k, n in sizes.items()})
    r = ranked(df, ["_key"], order, sum(sizes.values()), "_rank")
    r = r.join(sources, F.col("_key") == F.col("_source"))
    r = r.withColumn("block", F.floor(F.col("_rank") / F.lit(block)).cast("bigint"))
    r = r.join(table, (F.col("_number") == F.col("_of")) & (F.col("block") == F.col("_index")))
    times = f"cast({slots} as decimal(18, 0))"  # products may have more than 64 bits
    share = "cast(_share as decimal(18, 0))"
    return r.select(
        *df.columns,
        (F.col("_share") / slots).alias("weight"),
        "block",
        F.expr(f"cast(block as decimal(18, 0)) * {times} div {share}").alias("release"),
        F.expr(f"(cast(block + 1 as decimal(18, 0)) * {times} + {share} - 1) div {share}").alias("deadline"),
        F.col("_slot").alias("slot"),
        F.pmod("_rank", F.lit(block)).cast("int").alias("place"),
        "_turn",
    )


def schedule_rows(df: DataFrame, weights: dict[str | None, float] | None = None, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text", block: int = BLOCK) -> DataFrame:
    """One row per input row: doc_id, source, weight (in the cycle), block, release, deadline, slot, place (in its block).

    Ordering by slot and place gives the mixture. Sources that weights doesn't name get the least weight named; names that
    df lacks are ignored. A null source is a source like any other. Repeated rows have places of their own. An empty table
    gives an empty result.
    """
    slim = df.select(F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), _key(F.col(source_col)).alias("_key"), F.xxhash64(F.col(id_col), F.col(text_col)).alias("_hash"))
    slim = written(slim, "sources")
    by, sizes = _weights(slim, F.col("_key"), weights)
    if not sizes:
        by, sizes = {"null": 1.0}, {"null": 0}
    return _placed(slim, ["_hash", "doc_id"], by, sizes, block).drop("_key", "_hash", "_turn")


def keyed(df: DataFrame, source_col: str = "source") -> DataFrame:
    """df with _key and _hash, from which turned() finds the places that mixed_rows gives to df's rows."""
    return df.withColumns({"_key": _key(F.col(source_col)), "_hash": row_hash(df)})


def turned(rows: DataFrame, weights: dict[str | None, float] | None = None, block: int = BLOCK) -> DataFrame:
    """Adds _turn, the number of the row's block in the order of the mixture, to a written table with _key and _hash."""
    by, sizes = _weights(rows, F.col("_key"), weights)
    if not sizes:
        by, sizes = {"null": 1.0}, {"null": 0}
    return _placed(rows, ["_hash"], by, sizes, block).select(*rows.columns, "_turn")


def mixed_rows(df: DataFrame, weights: dict[str | None, float] | None = None, source_col: str = "source", block: int = BLOCK) -> DataFrame:
    """df's rows, with all columns and in the order of the mixture. df must give the same rows each time it is read."""
    by, sizes = _weights(df, _key(F.col(source_col)), weights)
    if not sizes:
        return df
    full = df.select(F.struct("*").alias("_all"), _key(F.col(source_col)).alias("_key"), row_hash(df).alias("_hash"))
    return _placed(full, ["_hash"], by, sizes, block).orderBy("slot", "place").select("_all.*")


def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return schedule_rows(spark.read.parquet(f"{sf_dir}/documents.parquet"))
