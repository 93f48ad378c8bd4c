"""Operator 10, packing: optimal length buckets by dynamic programming over the global length histogram, token-budget batches inside each bucket.

Method. The lengths of all documents are counted exactly (one row for each distinct length reaches the driver, as Arrow columns; lengths are integers, so their number is bounded by the
longest text, and none is rounded). Dynamic programming finds the at most `n_buckets` bucket ends with the least padding, exactly: cost(i, j) is the
padding of lengths i..j in a bucket that ends at j; it fulfils the quadrangle inequality, so divide and conquer takes
O(buckets * distinct * log distinct), a level at a time in numpy. In a bucket of padded length L every batch holds floor(budget / L) documents (one at least);
documents are ranked within their bucket by hash and batches are cut by rank, so each bucket has one incomplete batch at most.
The rank is found without gathering a bucket: each bucket is dealt over shards of about SHARD_ROWS rows by a hash of id, length and row number, so that
rows of one id are dealt like any others, ranked in its shard, and shifted by the sizes of the shards before it.

Columns: doc_id, n_tokens, bucket (from 0, by length), padded (its end), batch (number within the bucket), slot (place in the batch), padding.

Edge cases. Text null or empty: 0 tokens; such documents are packed like others (a bucket's end is at least 1). A document longer than the
budget has a batch to itself. Repeated rows and ids: each row has its own slot. Empty table: no rows. A column of lengths can be given instead of texts.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import SPACE, saved

N_BUCKETS, BUDGET, SHARD_ROWS = 16, 16_384, 1_000


def n_words(text) -> F.Column:
    """Number of words, without an array of them: breaks between words in the trimmed text, and one."""
    blank = "\t\n\x0b\x0c\r "
    trimmed = F.btrim(F.coalesce(text, F.lit("")), F.lit(blank))
    return F.when(trimmed == "", F.lit(0)).otherwise(F.regexp_count(trimmed, F.lit(SPACE)) + 1)


def best_ends(lengths: list[int], counts: list[int], n_buckets: int = N_BUCKETS) -> list[int]:
    """Ends of the buckets with the least padding; lengths ascending and distinct. Exact, in whole numbers."""
    m = len(lengths)
    if not m:
        return []
    k = min(n_buckets, m)
    kind = np.int64 if int(lengths[-1]) * int(np.sum(counts)) < 1 << 63 else object
    size, count = np.asarray(lengths).astype(kind), np.asarray(counts).astype(kind)
    many, total = np.concatenate([[0], np.cumsum(count)]).astype(kind), np.concatenate([[0], np.cumsum(size * count)]).astype(kind)
    best = size * many[1:] - total[1:]  # one bucket for lengths 0..j
    choice = np.zeros((k, m), np.int32)
    for b in range(1, k):
        after = np.zeros(m, kind)  # below b: never read
        low, high, first, last = (np.array([x]) for x in (b, m - 1, b, m - 1))
        while low.size:  # a level of halves; the best first length of the last bucket never falls as j grows
            j = (low + high) // 2
            n = np.minimum(j, last) - first + 1
            start = np.cumsum(n) - n
            i = np.arange(n.sum()) + np.repeat(first - start, n)
            to = np.repeat(j, n)
            cost = best[i - 1] + size[to] * (many[to + 1] - many[i]) - (total[to + 1] - total[i])
            least = np.minimum.reduceat(cost, start)
            hits = np.flatnonzero(cost == np.repeat(least, n))
            at = i[hits[np.searchsorted(hits, start)]]
            after[j], choice[b, j] = least, at
            low, high, first, last = np.concatenate([low, j + 1]), np.concatenate([j - 1, high]), np.concatenate([first, at]), np.concatenate([at, last])
            left = low <= high
            low, high, first, last = (x[left] for x in (low, high, first, last))
        best = after
    ends, j = [], m - 1
    for b in range(k - 1, -1, -1):
        ends.append(int(lengths[j]))
        j = int(choice[b, j]) - 1
    return ends[::-1]


def pack(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", length_col: str | None = None, n_buckets: int = N_BUCKETS, budget: int = BUDGET) -> DataFrame:
    length = F.greatest(F.coalesce(F.col(length_col).cast("long"), F.lit(0)), F.lit(0)) if length_col else n_words(F.col(text_col)).cast("long")
    # the row's number deals rows of one id and length over shards; it's written, so it stays what it is
    sized = saved(docs.select(F.col(id_col).alias("doc_id"), length.alias("n_tokens"), F.monotonically_increasing_id().alias("_row")), "lengths")
    rounded = F.greatest("n_tokens", F.lit(1))
    histogram = sized.groupBy(rounded.alias("x")).count().toArrow().sort_by("x")
    lengths, counts = (histogram[c].to_numpy() for c in ("x", "count"))
    ends = best_ends(lengths, counts, n_buckets) or [1]
    held = np.add.reduceat(counts, [0, *np.searchsorted(lengths, ends[:-1], side="right")]) if len(lengths) else [0]

    last = len(ends) - 1
    bucket = F.coalesce(*(F.when(rounded <= e, F.lit(i)) for i, e in enumerate(ends)), F.lit(last))
    shards = F.element_at(F.array(*(F.lit(max(1, -(-int(n) // SHARD_ROWS))) for n in held)), F.col("bucket") + 1)
    salted = sized.withColumn("bucket", bucket).withColumn("shard", F.pmod(F.xxhash64("doc_id", "n_tokens", "_row"), F.lit(1 << 20)))
    salted = salted.withColumn("shard", (F.col("shard") * shards / (1 << 20)).cast("int"))
    sums = salted.groupBy("bucket", "shard").count()
    before = F.coalesce(F.sum("count").over(Window.partitionBy("bucket").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = sums.select("bucket", "shard", before.alias("before"))  # a row for each SHARD_ROWS documents
    ranked = salted.withColumn("rank", F.row_number().over(Window.partitionBy("bucket", "shard").orderBy(F.xxhash64("doc_id", "_row"), "_row")) - 1)
    placed = ranked.join(offsets, ["bucket", "shard"]).withColumn("rank", F.col("rank") + F.col("before"))
    padded = F.element_at(F.array(*(F.lit(e) for e in ends)), F.col("bucket") + 1).cast("long")
    fits = F.greatest(F.floor(F.lit(budget) / F.col("padded")), F.lit(1))
    placed = placed.withColumn("padded", padded).withColumn("fits", fits)
    return placed.select("doc_id", "n_tokens", "bucket", "padded", F.floor(F.col("rank") / F.col("fits")).cast("long").alias("batch"), (F.col("rank") % F.col("fits")).cast("int").alias("slot"), (F.col("padded") - F.col("n_tokens")).alias("padding"))


def op10(spark, sf_dir: str) -> DataFrame:
    from .common import table

    return pack(table(spark, sf_dir, "documents"))
