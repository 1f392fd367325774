"""Histogram sort: exact splitters by counting bytes below candidate key boundaries, then one exchange."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sitewise.llm.common import KEY_BITS, forget, fresh, settle

FIRST_BITS = 12
STEP_BITS = 8


def _prefix(key: str, bits: int) -> Column:
    return F.shiftright(F.col(key), KEY_BITS - bits)


def _histogram(rows: DataFrame, bits: int) -> list[tuple[int, int, int, int]]:
    """(prefix, bytes, least key, greatest key) in order; the caller bounds the number of prefixes."""
    found = rows.groupBy(_prefix("key", bits).alias("p")).agg(
        F.sum("size").alias("b"), F.min("key").alias("lo"), F.max("key").alias("hi")
    )
    return sorted((r["p"], r["b"], r["lo"], r["hi"]) for r in found.collect())


def splitters(rows: DataFrame, n_shards: int, tolerance: float = 0.0) -> list[int]:
    """n_shards - 1 keys; shard k holds the keys from splitter k - 1 up to splitter k.

    rows: key (0 to 2^60), size. Every round counts bytes per key prefix exactly, over all
    partitions; the first has 2^12 prefixes, each later one refines only the prefixes that hold a
    wanted boundary by 8 more bits, so at most 256 * n_shards counts come back. It ends when what is
    left to decide is a single key, or no more than `tolerance` of a shard's bytes.
    """
    first = _histogram(rows, FIRST_BITS)
    total = sum(x[1] for x in first)
    out: dict[int, int] = {}
    pending = dict.fromkeys(range(1, n_shards), (None, 0))  # boundary -> (prefix that holds it, bytes before it)
    bits, level = FIRST_BITS, {None: first}
    while pending:
        nxt: dict[int, tuple[int, int]] = {}
        for k, (within, before) in pending.items():
            for p, b, lo, hi in level.get(within, []):
                if n_shards * (before + b) >= k * total:  # the last key with less than k/n of all bytes before it
                    if lo == hi or bits == KEY_BITS:
                        out[k] = hi + 1
                    elif n_shards * b <= tolerance * total:
                        out[k] = (p + 1) << (KEY_BITS - bits)
                    else:
                        nxt[k] = (p, before)
                    break
                before += b
            else:
                out[k] = 1 << KEY_BITS
        if nxt:
            step = min(STEP_BITS, KEY_BITS - bits)
            wanted = sorted({p for p, _ in nxt.values()})
            found = _histogram(rows.where(_prefix("key", bits).isin(wanted)), bits + step)
            level = {}
            for x in found:
                level.setdefault(x[0] >> step, []).append(x)
            bits += step
        pending = nxt
    return [out[k] for k in range(1, n_shards)]


def histogram_shards(
    docs: DataFrame, key: Column, size: Column, n_shards: int = 16, tolerance: float = 0.0, order: tuple[str, ...] = ()
) -> DataFrame:
    """docs with shard (int, from 0) and slot (long, gapless from 0 in its shard), split by bytes.

    key: a long from 0 to 2^60, spread evenly; size: bytes of a row, more than 0. The shard of a row
    follows from its key alone, and with tolerance 0 a shard begins at the first key before which
    k/n of all bytes lie, so shards differ by less than the largest row. Rows with one key stay
    together: only rows that repeat one another whole share a key when it is made of the row's
    content. Slots follow the key, then the columns named in `order`; rows equal in all of these
    may swap. The key's 2^12 prefixes divide every shard, so no window sees a whole shard, and the
    only table that is broadcast has at most 2^12 + n_shards rows. An empty table gives no rows;
    input columns named shard or slot are replaced.
    """
    docs = docs.drop("shard", "slot")
    k, s, part, start = fresh(docs, "_key", "_size", "_part", "_start")
    keyed = docs.withColumns({k: key, s: size})
    narrow = settle(keyed.select(F.col(k).alias("key"), F.col(s).alias("size")))
    cuts = splitters(narrow, n_shards, tolerance)

    def placed(df: DataFrame, key_name: str) -> DataFrame:
        shard = F.lit(0)
        for cut in cuts:
            shard = shard + (F.col(key_name) >= F.lit(cut)).cast("int")
        return df.withColumns({"shard": shard, part: _prefix(key_name, FIRST_BITS)})

    sizes = placed(narrow, "key").groupBy("shard", part).agg(F.count("*").alias("n"))
    earlier = Window.partitionBy("shard").orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    starts = settle(sizes.select("shard", part, F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias(start)))
    forget(narrow)
    inside = F.row_number().over(Window.partitionBy("shard", part).orderBy(k, *order)).cast("bigint")
    ranked = placed(keyed, k).withColumn("slot", inside - 1).join(F.broadcast(starts), ["shard", part])
    return ranked.select(*docs.columns, "shard", (F.col("slot") + F.col(start)).alias("slot"))


def write_shards(sharded: DataFrame, path: str) -> None:
    """One folder per shard; the files of a shard hold its rows in runs of rising slots."""
    run = F.floor(F.col("slot") / (1 << 20))
    sharded.repartition("shard", run).sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)
