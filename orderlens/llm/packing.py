"""Packing documents into batches of a token budget, in length buckets that waste least.

A document's tokens are its words and one end; it is cut into sequences of at most
``max_len`` tokens. The histogram of sequence lengths over the whole corpus (max_len numbers
at most) goes to the driver, where dynamic programming chooses the bucket lengths with the
least padding. In a bucket of length L a batch holds floor(budget / L) sequences, dealt in
the order (length, doc_id, part).

Defined cases: a missing or empty text is one sequence holding the end alone; a text longer
than ``max_len`` becomes several sequences and loses nothing; equal rows are packed one
after the other; an empty table gives no rows; a bucket longer than the budget gets batches
of one sequence.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from orderlens.llm.common import stored, word_count


def bucket_lengths(histogram: dict[int, int], buckets: int) -> list[int]:
    """The at most ``buckets`` bucket lengths with the least padding over a histogram of
    lengths; of equally good choices the one with the fewest buckets, then shorter bounds.
    """
    lengths = np.array(sorted(k for k, n in histogram.items() if n), dtype=np.int64)
    if not len(lengths):
        return []
    counts = np.array([histogram[k] for k in lengths.tolist()], dtype=np.int64)
    # Rows up to each length: a bucket over (i, j] pads its rows to lengths[j - 1].
    rows = np.concatenate(([0], np.cumsum(counts)))
    many = len(lengths)
    best = np.full(many + 1, np.iinfo(np.int64).max // 2)
    best[0] = 0
    choice = []
    for _ in range(min(buckets, many)):
        after, cut = best.copy(), np.full(many + 1, -1)
        for j in range(1, many + 1):
            cost = best[:j] + (rows[j] - rows[:j]) * lengths[j - 1]
            i = int(cost.argmin())
            if cost[i] < after[j]:
                after[j], cut[j] = cost[i], i
        best = after
        choice.append(cut)
    bounds, j = [], many
    for cut in reversed(choice):
        if cut[j] >= 0:
            bounds.append(int(lengths[j - 1]))
            j = int(cut[j])
    return bounds[::-1]


def sequences(docs: DataFrame, max_len: int) -> DataFrame:
    """(doc_id, part, n_tokens): every document cut into pieces of at most max_len tokens."""
    last = F.floor((F.col("total") - 1) / max_len)
    return (docs.select("doc_id", (word_count("text") + 1).alias("total"))
            .withColumn("part", F.explode(F.sequence(F.lit(0), last.cast("int"))))
            .withColumn("n_tokens", F.least(
                F.lit(max_len), F.col("total") - F.col("part") * max_len).cast("int"))
            .select("doc_id", "part", "n_tokens"))


def pack(docs: DataFrame, max_len: int = 2048, budget: int = 16384, buckets: int = 16,
         cell_rows: int = 20_000) -> DataFrame:
    """One row per sequence: doc_id, part, n_tokens, bucket (its length), batch (number in
    the bucket), slot (place in the batch), padding.

    Sequences are numbered per bucket without sorting a bucket whole: each length is dealt
    into cells by hash of the id, about ``cell_rows`` rows each; cells are numbered by
    running sums of their counts, rows inside their cell.
    """
    rows = stored(sequences(docs, max_len), "sequences")
    counts = {r["n_tokens"]: r["count"] for r in rows.groupBy("n_tokens").count().collect()}
    bounds = bucket_lengths(counts, buckets)
    if not bounds:
        bounds = [max_len]
    # Looked up by length, at most max_len numbers each.
    lengths = range(1, max(bounds) + 1)
    bucket = F.array(*[F.lit(min(b for b in bounds if b >= k)) for k in lengths])
    cells = F.array(*[F.lit(-(-counts.get(k, 1) // cell_rows)) for k in lengths])
    dealt = (rows.withColumn("bucket", F.element_at(bucket, F.col("n_tokens")))
             .withColumn("cell", F.pmod(F.xxhash64("doc_id", "part"),
                                        F.element_at(cells, F.col("n_tokens")))))
    key = ["bucket", "n_tokens", "cell"]
    sums = dealt.groupBy(*key).agg(F.count("*").alias("rows"))
    before = F.sum("rows").over(Window.partitionBy("bucket").orderBy("n_tokens", "cell")
                                .rowsBetween(Window.unboundedPreceding, -1))
    sums = sums.select(*key, F.coalesce(before, F.lit(0)).alias("before"))
    own = F.row_number().over(Window.partitionBy(*key).orderBy("doc_id", "part"))
    size = F.greatest(F.lit(1), F.floor(F.lit(budget) / F.col("bucket")))
    return (dealt.withColumn("own", own).join(sums, key)
            .withColumn("place", F.col("before") + F.col("own") - 1)
            .select("doc_id", "part", "n_tokens", "bucket",
                    F.floor(F.col("place") / size).cast("long").alias("batch"),
                    (F.col("place") % size).cast("int").alias("slot"),
                    (F.col("bucket") - F.col("n_tokens")).alias("padding")))
