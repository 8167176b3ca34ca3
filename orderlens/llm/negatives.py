"""Hard negatives by Fagin's threshold algorithm.

Candidates lie in blocks of one label. A block keeps, for every dimension, its rows in order of
that component: the sorted lists. An anchor reads all lists in step, from the top where its own
component is positive and from the bottom where it is negative, and scores every row it meets
there for the first time in full, as an integer inner product (random access). What no list has
shown yet scores at most the threshold, the sum of the anchor's products with the components
last read. The anchor stops in a block once that is strictly below the last score that each of
its windows still wants: the k-th best found so far, or the window's lower end.

One sweep over the blocks of the anchor's own label finds its positives, a second one over the
others the negatives of each positive's window. A task of a sweep holds a block of anchors and one
block of candidates at a time, takes the candidates' blocks one after the other, and passes on
only the best of each window. A label that holds most rows is many blocks like any other.

Defined cases: a row without vec_id, label or vector, or with a missing or non-finite component,
takes no part; shorter vectors count as padded with zeros; rows repeated whole are one row; rows
that share the anchor's vec_id are not its candidates, and different vectors under one vec_id are
different rows (and different anchors); scores are exact while they fit a long; an anchor without
positives, or a positive whose window is empty, gives no rows; an empty table gives none; other
columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from orderlens.llm.common import in_arrow, stored

#: Components of a block of candidates, and anchors of a block of anchors.
CELLS, ANCHORS_IN_BLOCK = 1 << 18, 512
#: Tasks that share the candidates' blocks for one block of anchors.
RUNS = 16
#: Rows first read of each sorted list; each further step reads four times as far.
FIRST = 64
LEAST = -(2 ** 63)


def quantised(rows: DataFrame, scale: float) -> DataFrame:
    """(vec_id, label, v): components floor(scale * x) as packed longs, trailing zeros left out."""
    def work(batch):
        kept, packed = [], []
        for k, x in enumerate(batch.column(2).to_pylist()):
            if x is None or any(c is None for c in x):
                continue
            scaled = scale * np.array(x, dtype=np.float64)
            if np.isfinite(scaled).all():
                whole = np.trim_zeros(np.floor(scaled).clip(-2.0 ** 62, 2.0 ** 62), "b")
                kept.append(k)
                packed.append(whole.astype("<i8").tobytes())
        own = batch.take(pa.array(kept, pa.int32()))
        return {"vec_id": own.column(0), "label": own.column(1), "v": packed}

    good = rows.where("vec_id IS NOT NULL AND label IS NOT NULL")
    return in_arrow(good.select(F.col("vec_id").cast("long"), F.col("label").cast("long"), "embedding"),
                    work, "vec_id long, label long, v binary")


class Lists:
    """A block of candidates with its sorted list of every dimension."""

    def __init__(self, ids: np.ndarray, values: np.ndarray):
        self.ids, self.values, self.floats = ids, values, values.astype(np.float64)
        self.order = np.argsort(values, axis=0, kind="stable")
        self.sorted = np.take_along_axis(values, self.order, axis=0)
        self.top = float(np.abs(self.floats).max(initial=0))

    def exact(self, anchor: np.ndarray) -> np.ndarray:
        """The components as floating point while every inner product fits its mantissa."""
        most = float(np.abs(anchor.astype(np.float64)).sum()) * self.top
        return self.floats if most < 2 ** 53 else self.values


def steps(lists: Lists, anchor: np.ndarray):
    """(rows first met, their scores, threshold of what is left) for each step down the lists;
    the last threshold is None: no row is left.
    """
    n, values = len(lists.ids), lists.exact(anchor)
    kind = values.dtype
    weights = anchor.astype(kind)
    up, down = np.flatnonzero(anchor > 0), np.flatnonzero(anchor < 0)
    met, start, depth = np.zeros(n, bool), 0, min(FIRST, n)
    while start < n:
        shown = np.zeros(n, bool)
        if depth == n or not len(up) + len(down):  # without a component all scores are zero
            shown[:], depth = True, n
        else:
            shown[lists.order[n - depth:n - start, up].ravel()] = True
            shown[lists.order[start:depth, down].ravel()] = True
        new = np.flatnonzero(shown & ~met)
        met |= shown
        bound = None
        if depth < n:
            ends = np.concatenate((lists.sorted[n - depth, up], lists.sorted[depth - 1, down]))
            bound = ends.astype(kind) @ np.concatenate((weights[up], weights[down]))
        yield new, (values[new] @ weights).astype(np.int64), bound
        start, depth = depth, min(4 * depth, n)


class Best:
    """The k best (score, vec_id) found so far with scores of a window."""

    def __init__(self, low: int, high: int, k: int):
        self.low, self.high, self.k = low, high, k
        self.scores, self.ids = np.empty(0, np.int64), np.empty(0, np.int64)

    def wants(self) -> int:
        """No lower score can enter."""
        return int(self.scores[-1]) if len(self.scores) == self.k else self.low

    def offer(self, scores: np.ndarray, ids: np.ndarray) -> None:
        inside = (scores >= self.wants()) & (scores <= self.high)
        if inside.any():
            scores = np.concatenate((self.scores, scores[inside]))
            ids = np.concatenate((self.ids, ids[inside]))
            first = np.lexsort((ids, ~scores))[:self.k]
            self.scores, self.ids = scores[first], ids[first]


def search(lists: Lists, own: int, anchor: np.ndarray, windows: list[Best]) -> None:
    """Offers the block's rows to the anchor's windows until none can want another."""
    for new, scores, bound in steps(lists, anchor):
        ids = lists.ids[new]
        others = ids != own
        for window in windows:
            window.offer(scores[others], ids[others])
        if bound is not None and bound < min(window.wants() for window in windows):
            return


ROW = "vec_id long, label long, v binary, low array<long>, high array<long>, windows array<long>, aid long"
FOUND = "aid long, window long, vec_id long, score long"


def sweep(anchors: DataFrame, candidates: DataFrame, same_label: bool, k: int) -> DataFrame:
    """(aid, window, vec_id, score): candidates for the k best rows of every window of every
    anchor (vec_id, label, v, low, high, windows, aid), among the candidates (block, vec_id, label, v).
    """
    runs = F.explode(F.sequence(F.lit(0), F.lit(RUNS - 1)))
    asked = anchors.withColumns({"role": F.lit(0), "block": F.lit(0).cast("long")})
    if same_label:
        # Anchors of one label, so that a block only goes to those that search it.
        sizes = anchors.groupBy("label").agg(F.ceil(F.count("*") / ANCHORS_IN_BLOCK).alias("groups"))
        asked = asked.join(sizes, "label").withColumn(
            "group", F.xxhash64("label", F.pmod(F.xxhash64("aid"), F.col("groups"))))
        given = candidates.join(asked.select("label", "group").distinct(), "label")
    else:
        groups = max(1, -(-anchors.count() // ANCHORS_IN_BLOCK))
        asked = asked.withColumn("group", F.pmod(F.xxhash64("aid"), F.lit(groups)))
        every = F.sequence(F.lit(0).cast("long"), F.lit(groups - 1).cast("long"))
        given = candidates.withColumn("group", F.explode(every))
    none = F.lit(None).cast("array<long>")
    given = given.withColumns({
        "role": F.lit(1), "run": F.pmod(F.xxhash64("block", "label"), F.lit(RUNS)).cast("int"),
        "low": none, "high": none, "windows": none, "aid": F.lit(None).cast("long")})
    columns = ["group", "run", "role", "block", *[c.split()[0] for c in ROW.split(", ")]]
    both = asked.withColumn("run", runs).select(*columns).unionByName(given.select(*columns))

    def run(batches):
        state, queries, block, ids, vectors = None, [], None, [], []

        def search_block():
            if not ids:
                return
            width = max([len(v) for v in vectors] + [len(q[2]) for q in queries] + [1])
            values = np.zeros((len(ids), width), np.int64)
            for k, v in enumerate(vectors):
                values[k, :len(v)] = v
            lists = Lists(np.array(ids, np.int64), values)
            for aid, own, v, label, names, windows in queries:
                if (label == block[1]) == same_label:
                    search(lists, own, np.pad(v, (0, width - len(v))), windows)

        def found():
            rows = [(q[0], name, w) for q in queries for name, w in zip(q[4], q[5]) if len(w.ids)]
            sizes = [len(w.ids) for _, _, w in rows]
            return pa.RecordBatch.from_pydict({
                "aid": pa.array(np.repeat(np.array([r[0] for r in rows], np.int64), sizes)),
                "window": pa.array(np.repeat(np.array([r[1] for r in rows], np.int64), sizes)),
                "vec_id": pa.array(np.concatenate([r[2].ids for r in rows] or [np.empty(0, np.int64)])),
                "score": pa.array(np.concatenate([r[2].scores for r in rows] or [np.empty(0, np.int64)]))})

        for batch in batches:
            for row in zip(*(batch.column(c).to_pylist() for c in columns)):
                r = dict(zip(columns, row))
                if (r["group"], r["run"]) != state:
                    search_block()
                    if queries:
                        yield found()
                    state, queries, block, ids, vectors = (r["group"], r["run"]), [], None, [], []
                v = np.frombuffer(r["v"], "<i8")
                if r["role"] == 0:
                    queries.append((r["aid"], r["vec_id"], v, r["label"], r["windows"],
                                    [Best(a, b, k) for a, b in zip(r["low"], r["high"])]))
                    continue
                if (r["block"], r["label"]) != block:
                    search_block()
                    block, ids, vectors = (r["block"], r["label"]), [], []
                ids.append(r["vec_id"])
                vectors.append(v)
        search_block()
        if queries:
            yield found()

    return (both.repartition("group", "run")
            .sortWithinPartitions("group", "run", "role", "block", "label").mapInArrow(run, FOUND))


def best(found: DataFrame, k: int) -> DataFrame:
    """The k best of every window, with their rank, ties to the smaller vec_id."""
    rank = F.row_number().over(Window.partitionBy("aid", "window").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k)


def hard_negatives(rows: DataFrame, is_anchor: Column, label: Column, scale: float = 256.0,
                   positives: int = 5, negatives: int = 3, low: int = 50, high: int = 95) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score: for every anchor
    and each of its best ``positives`` rows of the same label, the best ``negatives`` rows of other
    labels that score ``low`` to ``high`` percent of the positive.
    """
    vectors = stored(quantised(rows.withColumn("label", label), scale).distinct(), "vectors")
    width = vectors.agg(F.max(F.length("v"))).first()[0] or 8
    in_block = max(64, CELLS * 8 // width)
    sizes = vectors.groupBy("label").agg(F.ceil(F.count("*") / in_block).alias("blocks"))
    candidates = vectors.join(sizes, "label").withColumn(
        "block", F.pmod(F.xxhash64("vec_id", "v"), F.col("blocks"))).drop("blocks")
    anchors = stored(vectors.where(is_anchor).withColumn("aid", F.monotonically_increasing_id()), "anchors")

    everything = {"low": F.array(F.lit(LEAST)), "high": F.array(F.lit(2 ** 63 - 1)),
                  "windows": F.array(F.lit(0).cast("long"))}
    near = stored(best(sweep(anchors.withColumns(everything), candidates, True, positives), positives)
                  .select("aid", F.col("rank").cast("long").alias("window"), F.col("vec_id").alias("positive_id"),
                          F.col("score").alias("positive_score")), "positives")
    # The scores s with low * positive <= 100 * s <= high * positive.
    wide = F.col("positive_score").cast("decimal(38,0)")
    ends = (near.withColumns({"low": F.expr(f"cast(ceil(positive_score * {low}BD / 100BD) as long)"),
                              "high": F.expr(f"cast(floor(positive_score * {high}BD / 100BD) as long)")})
            .where("low <= high").groupBy("aid")
            .agg(F.sort_array(F.collect_list(F.struct("window", "low", "high"))).alias("all"))
            .select("aid", "all.low", "all.high", F.col("all.window").alias("windows")))
    windows = stored(anchors.join(ends, "aid"), "windows")
    hard = best(sweep(windows, candidates, False, negatives), negatives).select(
        "aid", "window", "rank", F.col("vec_id").alias("negative_id"), F.col("score").alias("negative_score"))
    named = anchors.select("aid", F.col("vec_id").alias("anchor_id"))
    return (hard.join(near, ["aid", "window"]).join(named, "aid")
            .select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"))


def mine_table(rows: DataFrame) -> DataFrame:
    """Every fiftieth row an anchor; every seventh row has the next of ten labels."""
    moved = F.expr("CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END")
    return hard_negatives(rows, F.expr("vec_id % 50 = 0"), moved)


SQL = """
WITH good AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
    [floor(256 * x::DOUBLE)::BIGINT for x in embedding] AS v
  FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
    AND len([x for x in embedding if x IS NULL OR NOT isfinite(x::DOUBLE)]) = 0),
pairs AS (
  SELECT a.vec_id AS anchor_id, c.vec_id, a.label = c.label AS alike,
    list_inner_product(a.v::DOUBLE[], c.v::DOUBLE[])::BIGINT AS score
  FROM good a JOIN good c ON a.vec_id % 50 = 0 AND a.vec_id <> c.vec_id),
positives AS (
  SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM pairs WHERE alike
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5),
negatives AS (
  SELECT p.anchor_id, positive_id, vec_id AS negative_id, positive_score, score AS negative_score,
    row_number() OVER (PARTITION BY p.anchor_id, positive_id ORDER BY score DESC, vec_id)::INTEGER AS rank
  FROM positives p JOIN pairs n ON p.anchor_id = n.anchor_id AND NOT alike
    AND 50 * positive_score <= 100 * score AND 100 * score <= 95 * positive_score)
SELECT anchor_id, positive_id, rank, negative_id, positive_score, negative_score
FROM negatives WHERE rank <= 3
"""
