"""Sharding by a hypergeometric communication matrix.

Method. Rows are dealt to virtual partitions by a seeded hash and counted. The driver draws how
many rows of each partition go to each shard from the multivariate hypergeometric law, with the
shard sizes fixed beforehand (at most one apart). Rows are permuted inside their partition by a
second seeded hash, cut by the matrix row, exchanged, and permuted again inside their shard by a third, in
blocks of bounded size. The result is a uniform shuffle with exact shard sizes.

The first permutation is done on narrow hashes alone: its cuts, at most partitions x shards rows
of hashes, tell every row its shard where it stands, and whole rows move once, to their shard. Only rows
that equal a row at a cut are counted out one by one, as they may go to either side of it.

The driver holds partitions x shards counts and shards x blocks offsets. Partitions grow with the rows,
about ROWS_OF_PART each, up to MAX_PARTS; blocks hold about ROWS_OF_BLOCK.

Defined cases. Equal rows are interchangeable: each takes a slot of its own. Null ids and texts
hash as such; long texts count by their hash. An empty table gives an empty result. Columns named like the
operator's own (shard, slot) are replaced; all others pass through.
"""

from __future__ import annotations

import functools

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

ROWS_OF_PART, MIN_PARTS, MAX_PARTS, ROWS_OF_BLOCK = 20_000, 64, 16_384, 50_000


def shard_sizes(total: int, n_shards: int) -> np.ndarray:
    return np.full(n_shards, total // n_shards, np.int64) + (np.arange(n_shards) < total % n_shards)


def large_hypergeometric(draw: np.random.Generator, good: int, bad: int, wanted: int) -> int:
    """A draw from the hypergeometric law for any counts, by inversion of its probabilities.

    They come from the ratios of neighbours, outwards from the mode, as far as 12 standard deviations and 40 rows, beyond which less
    of the law lies than a double can tell from nothing."""
    low, high = max(0, wanted - bad), min(good, wanted)
    mode = min(max((good + 1) * (wanted + 1) // (good + bad + 2), low), high)
    share = good / max(1, good + bad)
    reach = 40 + int(12 * (wanted * share * (1 - share) * (good + bad - wanted) / max(1, good + bad - 1)) ** 0.5)
    low, high = max(low, mode - reach), min(high, mode + reach)
    at = np.arange(low, high, dtype=np.float64)  # from x to x + 1
    steps = np.log(good - at) + np.log(wanted - at) - np.log(at + 1) - np.log(bad - wanted + at + 1)
    logs = np.concatenate(([0.0], np.cumsum(steps)))
    sums = np.cumsum(np.exp(logs - logs[mode - low]))
    return low + min(int(np.searchsorted(sums, draw.random() * sums[-1], "right")), high - low)


def communication_matrix(rows_of: list[int], sizes: np.ndarray, seed: int) -> np.ndarray:
    """Counts by partition and shard with both margins exact, drawn uniformly over all shuffles."""
    draw = np.random.Generator(np.random.PCG64(seed))
    left, out = sizes.astype(np.int64).copy(), np.zeros((len(rows_of), len(sizes)), np.int64)
    for i, n in enumerate(rows_of):
        rest, wanted = int(left.sum()), int(n)
        for j in range(len(sizes)):  # the multivariate law as a chain of hypergeometric ones
            rest -= int(left[j])
            # numpy's sampler takes up to a billion rows of each kind
            sample = draw.hypergeometric if left[j] + rest < 1_000_000_000 else functools.partial(large_hypergeometric, draw)
            x = int(sample(int(left[j]), rest, wanted)) if wanted else 0
            out[i, j], wanted = x, wanted - x
        left -= out[i]
    return out


def _cuts(keys: DataFrame, n_parts: int, sizes: np.ndarray, seed: int) -> DataFrame:
    """keys (part, o, i) of all rows. For each partition: ends, the running counts of its matrix row; cuts, the key of the last row
    before each end (null for none); first, that key's place among the partition's rows."""
    spark = keys.sparkSession
    counts = dict(keys.groupBy("part").count().collect())  # n_parts rows
    matrix = communication_matrix([counts.get(p, 0) for p in range(n_parts)], sizes, seed)
    ends = spark.createDataFrame([(p, [int(x) for x in np.cumsum(matrix[p])]) for p in range(n_parts)], "part int, ends array<long>")
    order = Window.partitionBy("part").orderBy("o", "i")
    placed = keys.select("part", "o", "i", F.row_number().over(order).cast("long").alias("turn"), F.rank().over(order).cast("long").alias("first"))
    placed = placed.join(F.broadcast(ends), "part").filter(F.array_contains("ends", F.col("turn")))
    known = placed.groupBy("part").agg(F.map_from_entries(F.collect_list(F.struct("turn", F.struct("o", "i", "first")))).alias("at"))  # n_shards entries
    return ends.join(F.broadcast(known), "part", "left").select("part", "ends", F.transform("ends", lambda e: F.try_element_at("at", e)).alias("cuts"))


def hypergeometric_shuffle(df: DataFrame, identity: list[Column], n_shards: int = 40, seed: int = 17, n_parts: int | None = None, n_blocks: int | None = None) -> DataFrame:
    """df with shard (int, 0 to n_shards - 1) and slot (long, gapless from 0 in each shard).

    identity: the columns whose values decide a row's place; rows equal in them are interchangeable. n_parts, n_blocks: virtual
    partitions, and blocks in each shard; by default as the number of rows asks for."""
    df = df.drop("shard", "slot")
    total = df.count()
    n_parts = n_parts or min(MAX_PARTS, max(MIN_PARTS, -(-total // ROWS_OF_PART)))
    n_blocks = n_blocks or max(1, -(-total // (n_shards * ROWS_OF_BLOCK)))
    hashed = lambda k, *of: F.xxhash64(F.lit(seed * 8 + k), *of)
    key = F.struct(F.pmod(hashed(1, *identity), F.lit(n_parts)).cast("int").alias("part"), hashed(2, *identity).alias("o"), hashed(5, *identity).alias("i"))
    cuts = _cuts(df.select(key.alias("key")).select("key.*"), n_parts, shard_sizes(total, n_shards), seed)
    cuts = cuts.select(F.col("part").alias("__part"), "ends", "cuts")

    names = [F.col(f"`{c}`") for c in df.columns]
    row = df.select(F.struct(*names).alias("row"), key.alias("key"))
    row = row.join(F.broadcast(cuts), F.col("key.part") == F.col("__part"))  # n_parts rows of n_shards cuts each
    mine = F.struct(F.col("key.o").alias("o"), F.col("key.i").alias("i"))
    pair = lambda c: F.struct(c["o"].alias("o"), c["i"].alias("i"))
    at_cut = F.coalesce(F.exists("cuts", lambda c: c.isNotNull() & (pair(c) == mine)), F.lit(False))
    row = row.withColumn("at_cut", at_cut)
    before = F.size(F.filter("cuts", lambda c: c.isNull() | (pair(c) < mine))).cast("int")
    plain = row.filter("not at_cut").select("row", "key", before.alias("shard"), F.lit(0).cast("long").alias("turn"))
    # Rows equal to one at a cut: their places follow one another from the first of them on.
    tied = row.filter("at_cut").withColumn("nth", F.row_number().over(Window.partitionBy("key").orderBy("key")))
    first = F.filter("cuts", lambda c: c.isNotNull() & (pair(c) == mine))[0]["first"]
    tied = tied.withColumn("turn", (first + F.col("nth") - 1).cast("long"))
    tied = tied.select("row", "key", F.size(F.filter("ends", lambda e: e < F.col("turn"))).cast("int").alias("shard"), "turn")

    # A row's block and its place there: seeded hashes of its key, and of its turn where equal rows were counted out.
    dealt = plain.unionByName(tied).select("row", "shard", F.pmod(hashed(3, "key", "turn"), F.lit(n_blocks)).cast("int").alias("block"), hashed(4, "key", "turn").alias("o"), F.col("key.i").alias("i"))
    earlier = Window.partitionBy("shard").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    offsets = dealt.groupBy("shard", "block").count().select(F.col("shard").alias("s"), F.col("block").alias("b"), F.coalesce(F.sum("count").over(earlier), F.lit(0)).alias("from"))
    dealt = dealt.withColumn("in", F.row_number().over(Window.partitionBy("shard", "block").orderBy("o", "i")))
    dealt = dealt.join(F.broadcast(offsets), (F.col("shard") == F.col("s")) & (F.col("block") == F.col("b")))  # n_shards x n_blocks rows
    return dealt.select(*[F.col(f"row.`{c}`") for c in df.columns], "shard", (F.col("from") + F.col("in") - 1).cast("long").alias("slot"))


def digest_columns(text: Column) -> list[Column]:
    whole = F.coalesce(text.cast("string"), F.lit(""))
    return [(F.octet_length(whole) + 16).cast("long").alias("size"), F.crc32(whole).cast("long").alias("text_crc32")]


def sharded_digest(docs: DataFrame, n_shards: int = 40, seed: int = 17) -> DataFrame:
    """The contract's row per document, without moving the texts."""
    narrow = docs.select("doc_id", *digest_columns(F.col("text")))
    placed = hypergeometric_shuffle(narrow, [F.col("doc_id"), F.col("size"), F.col("text_crc32")], n_shards, seed)
    return placed.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
