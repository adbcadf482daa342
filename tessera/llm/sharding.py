"""Shard placement by a permutation-filled lookup table: every shard has its own preference order over the slots of a
prime-sized table, and the shards take turns in claiming their next free slot. A key's shard is the entry at its hash
modulo the table size; the table is broadcast, so placement is one lookup for each row, without a shuffle.

When a shard joins or leaves, few keys move that need not; a shard with weight w takes w turns in each round.

Size bound: the table has ``slots`` rows (a parameter, at most ``MAX_SLOTS``), whatever the data. Hot keys: with
``spread_by``, a key with more rows than ``rows_per_part`` is placed in several parts, each with its own lookup; there
are at most ``total rows / rows_per_part`` such keys, and that many rows of the key counts are broadcast.

Defined cases: null is a key of its own, apart from every string; repeated rows land on the same shard (the same part of
it, when spread by a column that is equal in them); an empty table gives no rows.
"""

from __future__ import annotations

import math

import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import common as C

SLOTS = 65_537
MAX_SLOTS = 4_194_301


def _is_prime(n: int) -> bool:
    return n > 1 and all(n % d for d in range(2, math.isqrt(n) + 1))


def fill_table(shards: list[str], slots: int = SLOTS, weights: dict[str, int] | None = None) -> list[int]:
    """Slot -> index of its shard in ``shards``."""
    if not shards or len(set(shards)) != len(shards):
        raise ValueError("shards must be given, with distinct names")
    if not _is_prime(slots) or not len(shards) <= slots <= MAX_SLOTS:
        raise ValueError(f"slots must be a prime between the number of shards and {MAX_SLOTS}")
    turns = [(weights or {}).get(s, 1) for s in shards]
    if min(turns) < 1:
        raise ValueError("weights are whole numbers from 1 on")
    place = [xxhash.xxh64_intdigest(s, seed=1) % slots for s in shards]
    step = [xxhash.xxh64_intdigest(s, seed=2) % (slots - 1) + 1 if slots > 1 else 0 for s in shards]
    table, free = [-1] * slots, slots
    while free:
        for k, n in enumerate(turns):
            for _ in range(min(n, free)):
                while table[place[k]] >= 0:
                    place[k] = (place[k] + step[k]) % slots
                table[place[k]] = k
                free -= 1
            if not free:
                break
    return table


def table_frame(spark: SparkSession, shards: list[str], slots: int = SLOTS, weights: dict[str, int] | None = None) -> DataFrame:
    return spark.createDataFrame([(i, k, shards[k]) for i, k in enumerate(fill_table(shards, slots, weights))], "slot int, shard int, shard_name string")


def slot_column(keys: list, slots: int):
    """Null flags are hashed too: xxhash64 skips nulls, which would make them equal to an absent column."""
    return F.pmod(F.xxhash64(*[x for k in keys for x in (k, k.isNull())]), F.lit(slots)).cast("int")


def place(rows: DataFrame, key: str, shards: list[str], slots: int = SLOTS, weights: dict[str, int] | None = None,
          spread_by: str | None = None, rows_per_part: int | None = None) -> DataFrame:
    """``rows`` with ``slot``, ``shard`` (index) and ``shard_name`` (with underscores in front if taken)."""
    spark, taken = rows.sparkSession, rows.columns
    slot, part, parts = (C.free_name(taken, n) for n in ("slot", "part", "parts"))
    shard, shard_name = C.free_name(taken, "shard"), C.free_name(taken, "shard_name")
    table = table_frame(spark, shards, slots, weights).toDF(slot, shard, shard_name)
    keys = [F.col(f"`{key}`").cast("string")]
    out = rows
    if spread_by is not None:
        counts = rows.groupBy(F.col(f"`{key}`").alias("hot_key")).count()
        total = counts.agg(F.sum("count")).first()[0] or 0
        bound = rows_per_part or max(1, total // (8 * len(shards)))
        hot = counts.where(F.col("count") > bound).select("hot_key", F.ceil(F.col("count") / F.lit(bound)).cast("int").alias(parts))
        joined = rows.join(F.broadcast(hot), F.col(f"`{key}`").eqNullSafe(F.col("hot_key")), "left").drop("hot_key")
        spread = F.pmod(F.xxhash64(F.col(f"`{spread_by}`")), F.coalesce(F.col(parts), F.lit(1)))
        out = joined.withColumn(part, F.when(F.col(parts).isNull(), 0).otherwise(spread.cast("int"))).drop(parts)
        keys.append(F.col(part).cast("string"))
    out = out.withColumn(slot, slot_column(keys, slots)).join(F.broadcast(table), slot)
    return out.drop(part).select(*[F.col(f"`{c}`") for c in taken], slot, shard, shard_name)


def write_shards(placed: DataFrame, path: str, shard: str = "shard") -> None:
    """One folder for each shard. Rows are dealt by (shard, salt), so a shard has several writers and files."""
    n = placed.select(shard).distinct().count()
    salted = placed.repartition(max(1, 4 * n), F.col(shard), F.pmod(F.xxhash64(*placed.columns), F.lit(4)))
    salted.write.mode("errorifexists").partitionBy(shard).parquet(path)


def digest(docs: DataFrame, n_shards: int = 64) -> DataFrame:
    """Documents are grouped by source; a large source is spread over several parts by doc_id."""
    shards = [f"shard-{i:05d}" for i in range(n_shards)]
    return place(docs.select("doc_id", "source"), "source", shards, spread_by="doc_id").select("doc_id", "source", "slot", "shard", "shard_name")
