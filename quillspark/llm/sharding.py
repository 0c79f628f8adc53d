"""Uniform shuffle into shards of exact sizes through a hypergeometric communication matrix."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quillspark.llm.common import materialise

#: Input partitions are merged until there are at most so many, which bounds the matrix on the driver.
MAX_PARTITIONS = 20_000
#: Rows that one task of the second permutation aims at.
BUCKET_ROWS = 1_000_000


def communication_matrix(partition_counts, n_shards: int, seed: int) -> np.ndarray:
    """Rows for input partitions, columns for shards: how many rows of each partition go to each shard.

    Distributed as in a uniform permutation of all rows cut into shards of exact sizes, at most one row
    apart: each partition draws from what the shards still have room for, without replacement.
    """
    counts = np.asarray(partition_counts, dtype=np.int64)
    total = int(counts.sum())
    room = np.full(n_shards, total // n_shards, dtype=np.int64)
    room[: total % n_shards] += 1
    draw = np.random.default_rng(seed)
    matrix = np.zeros((len(counts), n_shards), dtype=np.int64)
    for i, n in enumerate(counts):
        left, rest = int(n), int(room.sum())
        # One multivariate draw as a chain of univariate ones, which takes any population size.
        for j in range(n_shards):
            rest -= int(room[j])
            take = left if rest == 0 else _hypergeometric(draw, int(room[j]), rest, left)
            matrix[i, j] = take
            left -= take
            if not left:
                break
        room -= matrix[i]
    return matrix


def _hypergeometric(draw, good: int, bad: int, n: int) -> int:
    if not n or not good:
        return 0
    if good + bad < 1_000_000_000:  # the limit of the library's exact sampler
        return int(draw.hypergeometric(good, bad, n))
    return _by_inversion(draw.random(), good, bad, n)


def _by_inversion(u: float, good: int, bad: int, n: int) -> int:
    """The quantile u of a hypergeometric count, for populations of any size.

    Probabilities relative to the mode's come from the exact ratios of neighbours, over 12 standard deviations on both
    sides (what lies beyond is under 1e-30), so the work grows with the square root of n.
    """
    total = good + bad
    mode = (n + 1) * (good + 1) // (total + 2)
    width = 20 + int(12 * (n * (good / total) * (bad / total) * ((total - n) / max(1, total - 1))) ** 0.5)
    low, high = max(0, n - bad, mode - width), min(n, good, mode + width)
    k = np.arange(low, high, dtype=float)  # steps from k to k + 1
    steps = np.log(good - k) + np.log(n - k) - np.log(k + 1) - np.log(bad - n + k + 1)
    logs = np.concatenate([[0.0], np.cumsum(steps)])
    upto = np.cumsum(np.exp(logs - logs.max()))
    return low + int(np.searchsorted(upto, u * upto[-1], side="right"))


def shard_documents(
    docs: DataFrame, n_shards: int = 40, seed: int = 20, id_col: str = "doc_id", text_col: str = "text",
    carry: tuple[str, ...] = (),
) -> DataFrame:
    """(id, size, text_crc32, shard, slot, *carry), a row per input row; shard counts differ by one at most.

    1. Write what is dealt, with its input partition and a keyed hash; 2. draw the matrix on the driver from
    the partitions' counts; 3. rank each partition's rows by hash, which permutes them, and cut the ranks by the
    matrix row; 4. exchange by shard and slice of a second hash; 5. rank within slices, offset by the
    counts of the slices before, which permutes the shard and numbers it without gaps.

    No task holds a shard or depends on a key's frequency: a third of all rows with one doc_id or one text
    are spread like any others, as both hashes include the row's place. Null text: size 16, crc32 of
    nothing. Null ids and repeated rows are dealt like others. An empty table gives no rows. carry names
    further columns, such as the text, that travel along.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    own = docs.select(
        F.col(id_col).alias("_id"), (F.octet_length(text) + F.lit(16)).cast("long").alias("_size"),
        F.crc32(text.cast("binary")).alias("_crc"), *(F.col(c).alias(f"_carry_{c}") for c in carry),
    ).coalesce(MAX_PARTITIONS)
    own = own.withColumn("_part", F.spark_partition_id()).withColumn("_place", F.monotonically_increasing_id())
    own = own.withColumn("_key", F.xxhash64(F.lit(seed), "_id", "_crc", "_place"))
    own = materialise(own, "dealt")
    counts = sorted((r["_part"], r["n"]) for r in own.groupBy("_part").agg(F.count("*").alias("n")).collect())
    total = sum(n for _, n in counts)
    matrix = communication_matrix([n for _, n in counts], n_shards, seed)
    spark = docs.sparkSession
    cuts = spark.createDataFrame(
        [(p, [int(x) for x in np.cumsum(row)]) for (p, _), row in zip(counts, matrix)], "_part int, _upto array<bigint>"
    )
    local = Window.partitionBy("_part").orderBy("_key", "_place")
    # At most MAX_PARTITIONS rows of n_shards numbers.
    placed = (
        own.withColumn("_rank", F.row_number().over(local))
        .join(F.broadcast(cuts), "_part")
        .withColumn("shard", F.size(F.filter("_upto", lambda x: x < F.col("_rank"))))
        .drop("_upto", "_rank")
    )
    slices = max(1, -(-total // (n_shards * BUCKET_ROWS)), min(16, total // (n_shards * 16)))
    placed = placed.withColumn("_second", F.xxhash64(F.lit(seed + 1), "_id", "_crc", "_place"))
    placed = materialise(placed.withColumn("_slice", F.pmod("_second", F.lit(slices)).cast("int")), "placed")
    before = Window.partitionBy("shard").orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        placed.groupBy("shard", "_slice").agg(F.count("*").alias("_n"))
        .withColumn("_offset", F.coalesce(F.sum("_n").over(before), F.lit(0)))
        .drop("_n")
    )
    inside = Window.partitionBy("shard", "_slice").orderBy("_second", "_place")
    return (
        placed.withColumn("_rank", F.row_number().over(inside) - 1)
        .join(offsets, ["shard", "_slice"])
        .select(
            F.col("_id").alias(id_col), F.col("_size").alias("size"), F.col("_crc").alias("text_crc32"), "shard",
            (F.col("_offset") + F.col("_rank")).cast("long").alias("slot"),
            *(F.col(f"_carry_{c}").alias(c) for c in carry),
        )
    )


def write_shards(docs: DataFrame, path: str, rows_per_file: int = 100_000, **options) -> None:
    """Write whole documents as one Parquet folder per shard, in files of consecutive slots, rows in slot order."""
    dealt = shard_documents(docs, carry=("text",), **options)
    files = dealt.withColumn("_file", F.floor(F.col("slot") / rows_per_file)).repartition("shard", "_file")
    files.sortWithinPartitions("shard", "slot").drop("_file").write.partitionBy("shard").parquet(path)
