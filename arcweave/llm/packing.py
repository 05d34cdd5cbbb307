"""Packing into optimal length buckets with token-budget batches.

One pass counts rows by their exact number of tokens; W tokens in all have at
most sqrt(2 W) distinct lengths, so the histogram stays small for any corpus.
Dynamic programming over the distinct lengths chooses the bucket boundaries that
minimise total padding (every row is padded to its bucket's upper boundary). The
best split never moves down as the length grows, so each layer is solved by
halving, in O(lengths log lengths). Inside a bucket rows are ranked
by hash sub-groups and offsets, and ``budget // boundary`` rows form a batch, so
no batch exceeds the token budget unless one row alone does.

Defined cases: null text has 0 tokens and goes to the lowest bucket; a row
longer than the budget is a batch of its own; fewer distinct lengths than
buckets give one bucket each; repeated rows are packed as rows of their own; an
empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from arcweave.llm.draws import draw, range_of
from arcweave.llm.words import word_count
from arcweave.runtime import materialize, ranked_within

EXACT = 2048
BUCKETS = 16
BUDGET = 65_536


def length_bin(n: Column) -> Column:
    """The upper end of the bin of a length, for coarse histograms; ``pack`` counts exact lengths."""
    step = F.pow(F.lit(2.0), F.floor(F.log2(F.greatest(n, F.lit(1)).cast("double"))) - 6).cast("long")
    return F.when(n <= EXACT, n).otherwise((F.ceil(n / step) * step)).cast("long")


def _best_splits(base: np.ndarray, cum: np.ndarray, v: np.ndarray, m: int) -> np.ndarray:
    """For each j >= m the lowest i in [m - 1, j) with the least base[i] - v[j - 1] * cum[i]; i never falls as j grows.

    Positions are solved by halving: between two solved ones, a position searches only between their splits.
    """
    n = len(v) - m + 1
    found = np.empty(n, np.int64)
    step = 1 << (n - 1).bit_length()
    while step:
        mids = np.arange(step - 1, n, 2 * step)
        lo = np.where(mids - step >= 0, found[mids - step], m - 1)
        hi = np.where(mids + step < n, found[np.minimum(mids + step, n - 1)], len(v))
        hi = np.minimum(hi, mids + m - 1)
        sizes = hi - lo + 1
        starts = np.r_[0, np.cumsum(sizes)[:-1]]
        i = np.arange(int(sizes.sum())) - np.repeat(starts - lo, sizes)
        cost = base[i] - np.repeat(v[mids + m - 1], sizes) * cum[i]
        least = np.repeat(np.minimum.reduceat(cost, starts), sizes) if len(mids) else cost
        hits = np.flatnonzero(cost == least)
        first = hits[np.searchsorted(hits, starts)] if len(mids) else starts[:0]
        found[mids] = i[first]
        step //= 2
    return found


def optimal_boundaries(lengths: list[int], counts: list[int], buckets: int) -> list[int]:
    """Upper boundaries of at most ``buckets`` buckets with the least total padding; ties take the lower split."""
    order = np.argsort(lengths)
    v = np.asarray(lengths, np.int64)[order]
    c = np.asarray(counts, np.int64)[order]
    b = len(v)
    if not b:
        return []
    k = min(buckets, b)
    cum = np.r_[0, np.cumsum(c)]
    mass = np.r_[0, np.cumsum(c * v)]
    # best[j]: least padding of the first j bins; cost(i, j) = v[j-1] * (cum[j] - cum[i]) - (mass[j] - mass[i])
    big = np.iinfo(np.int64).max // 4
    best = np.full(b + 1, big, np.int64)
    best[0] = 0
    split = np.zeros((k + 1, b + 1), np.int32)
    for m in range(1, k + 1):
        at = _best_splits(best + mass, cum, v, m)
        split[m, m:] = at
        ends = np.arange(m, b + 1)
        nxt = np.full(b + 1, big, np.int64)
        nxt[m:] = (best + mass)[at] + v[ends - 1] * (cum[ends] - cum[at]) - mass[ends]
        best = nxt
    cuts, j = [], b
    for m in range(k, 0, -1):
        cuts.append(int(v[j - 1]))
        j = int(split[m, j])
    return cuts[::-1]


def pack(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", tokens: Column | None = None, buckets: int = BUCKETS, budget: int = BUDGET) -> DataFrame:
    """(id, n_tokens, bucket, bucket_len, padding, batch, batch_slot), one row per input row.

    ``tokens`` is the token count of a row; by default its number of words.
    ``batch`` counts from 0 within the bucket, ``batch_slot`` from 0 within the batch.
    Rows of a bucket are taken in the order of a draw from id and text, then of the id.
    """
    n = (tokens if tokens is not None else word_count(F.col(text_col))).cast("long")
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(n, F.lit(0)).alias("n_tokens"), draw(F.col(id_col), F.col(text_col)).alias("key"))
    rows = materialize(rows, "lengths")
    histogram = rows.groupBy(F.col("n_tokens").alias("len")).agg(F.count(F.lit(1)).alias("n")).collect()  # a row per distinct length
    bounds = optimal_boundaries([r.len for r in histogram], [r.n for r in histogram], buckets)
    bucket, size = F.lit(None).cast("int"), F.lit(None).cast("long")
    for i, u in reversed(list(enumerate(bounds))):
        bucket = F.when(F.col("n_tokens") <= u, F.lit(i)).otherwise(bucket)
        size = F.when(F.col("n_tokens") <= u, F.lit(u).cast("long")).otherwise(size)
    placed = rows.withColumn("bucket", bucket).withColumn("bucket_len", size)
    ranked = ranked_within(placed, ["bucket"], ["key", "doc_id"], "rank", salt=range_of(F.col("key")))
    per = F.greatest(F.lit(1).cast("long"), F.expr(f"{budget} div greatest(bucket_len, 1)"))
    return ranked.select(
        F.col("doc_id").alias(id_col), "n_tokens", "bucket", "bucket_len", (F.col("bucket_len") - F.col("n_tokens")).alias("padding"),
        F.floor(F.col("rank") / per).cast("long").alias("batch"), F.pmod("rank", per).cast("long").alias("batch_slot"),
    )
