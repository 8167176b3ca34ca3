"""Mixing sources to target weights by Pareto order sampling.

A source's target is a share of the whole mix. Documents are allotted whole copies first
(floor of target over source size). What is left is a fixed-size sample in words with
unequal probabilities: a document's inclusion grows with the square root of its size, so that
long documents come sooner and short ones still come, and the inclusions times the sizes add
up to what is left. Where that asks for more than 1 the document is certain: it is taken, and
its words are shared out among the others until none is above 1. Each other document gets a
random number u from its id and text, is ranked by odds(u) / odds(inclusion), and the lowest
ranks are taken until their words come nearest to the remainder.

Defined cases: a missing text has size 0 and is never taken; a missing source is a source
of its own, last in order; a missing doc_id counts as an empty one; an empty table gives no
rows; rows that agree in id, source and text are numbered and each has a random number of its own (as
they are alike it does not matter which has which); further columns, whatever their names,
are carried along by ``mix`` and ignored by the sampling.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from orderlens.llm.common import stored, word_count

#: Cells a source's ranks are counted in; done twice, so the last step sorts about one
#: document in CELLS * CELLS of a source.
CELLS = 1024


def key_of(doc_id: Column, text: Column, seed: str) -> Column:
    """Names what a document is: its id and its whole text."""
    return F.md5(F.concat(
        F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("")), F.lit(":"),
        F.md5(F.coalesce(text, F.lit("")).cast("binary"))).cast("binary"))


def uniform(key: Column, number: Column) -> Column:
    """A number in (0, 1) that depends on the document and its number among equal rows alone."""
    text = F.concat(key, F.lit(":"), number.cast("string"))
    digits = F.conv(F.substring(F.md5(text.cast("binary")), 1, 12), 16, 10).cast("double")
    return (digits + 0.5) / F.lit(float(16 ** 12))


def repeated_keys(rows: DataFrame) -> DataFrame:
    """(of, repeated): the documents that stand in more than one row."""
    return stored(rows.groupBy(F.col("source").alias("of"), F.col("key").alias("repeated"))
                  .agg(F.count("*").alias("times")).where("times > 1").drop("times"), "repeated")


def told_apart(rows: DataFrame, repeated: DataFrame) -> DataFrame:
    """Adds ``number``, counting rows that agree in source and key from 0.

    Only such rows are written, with the partition they came in, and are numbered inside it;
    a sum over partitions moves them. So a document that fills a third of all rows is not
    numbered by one task.
    """
    found = F.expr("source <=> of AND key = repeated")
    alone = rows.join(repeated, found, "left_anti").withColumn("number", F.lit(0).cast("long"))
    again = stored(rows.join(repeated, found, "left_semi")
                   .withColumn("dealt", F.spark_partition_id()), "again")
    before = F.coalesce(F.sum("times").over(
        Window.partitionBy("source", "key").orderBy("dealt")
        .rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = (again.groupBy("source", "key", "dealt").agg(F.count("*").alias("times"))
               .select(F.col("source").alias("of"), F.col("key").alias("repeated"),
                       F.col("dealt").alias("there"), before.alias("before")))
    own = F.row_number().over(Window.partitionBy("source", "key", "dealt").orderBy("key"))
    counted = (again.withColumn("own", own)
               .join(offsets, found & F.expr("dealt = there"))
               .withColumn("number", F.col("own") - 1 + F.col("before"))
               .drop("dealt", "there", "of", "repeated", "own", "before"))
    return alone.unionByName(counted)


def source_targets(sizes: DataFrame, weights: tuple[float, ...], share: float,
                   most: float) -> DataFrame:
    """(source, source_size, target) from (source, size) rows. Weights repeat over the
    sources in code point order, a missing source last. Targets sum to ``share`` of all
    sizes; none is above ``most`` times its source, the excess goes to the others by weight.

    Sources in order of limit / weight reach their limit one after the other, so the level
    at which the rest share by weight follows from running sums over the source list.
    """
    sources = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    place = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]),
                          (F.col("place") % len(weights) + 1).cast("int"))
    everything = Window.partitionBy()
    by_ratio = Window.orderBy("ratio", "place").rowsBetween(Window.unboundedPreceding, 0)
    filled = (
        sources.withColumn("place", place).withColumn("weight", weight)
        .withColumn("limit", F.col("source_size") * F.lit(float(most)))
        .withColumn("ratio", F.col("limit") / F.col("weight"))
        .withColumn("mass", F.least(F.sum("source_size").over(everything) * F.lit(float(share)),
                                    F.sum("limit").over(everything)))
        .withColumn("limits_below", F.sum("limit").over(by_ratio) - F.col("limit"))
        .withColumn("weights_left", F.sum("weight").over(everything)
                    - F.sum("weight").over(by_ratio) + F.col("weight"))
        .withColumn("level", (F.col("mass") - F.col("limits_below")) / F.col("weights_left")))
    # The level is right at the first source that it leaves below its limit.
    first = F.min(F.when(F.col("level") < F.col("ratio"), F.struct("ratio", "place", "level")))
    return (filled.withColumn("open", first.over(everything))
            .select("source", "source_size",
                    F.when(F.col("open").isNull(), F.col("limit"))
                    .otherwise(F.least("limit", F.col("weight") * F.col("open.level")))
                    .alias("target")))


def pareto_rank(u: Column, inclusion: Column) -> Column:
    """odds(u) / odds(inclusion), mapped to (0, 1) without changing the order."""
    odds = (u / (1 - u)) / (inclusion / (1 - inclusion))
    return odds / (1 + odds)


def inclusions(rows: DataFrame, targets: DataFrame) -> DataFrame:
    """(of, open, rate, rest): documents of a source above the size ``open`` are certain, one
    of another size has the inclusion rate * sqrt(size), and ``rest`` words are to be drawn.

    Inclusion depends on source and size only, so the sizes of a source are counted and
    certain sizes leave from the largest down: ``rate`` is right at the first size that it
    leaves below 1. A source of n words has fewer than sqrt(2 n) different sizes.
    """
    by_source = Window.partitionBy("of")
    down = by_source.orderBy(F.desc("size")).rowsBetween(Window.unboundedPreceding, 0)
    up = by_source.orderBy("size").rowsBetween(Window.unboundedPreceding, 0)
    words = F.col("size") * F.col("n")
    sizes = (rows.where("size > 0").groupBy("source", "size").agg(F.count("*").alias("n"))
             .join(targets.select("of", F.col("rest").alias("left")), same()).drop("source")
             .withColumn("above", F.sum(words).over(down) - words)
             .withColumn("rest", F.col("left") - F.col("above"))
             .withColumn("rate", F.col("rest") / F.sum(words * F.sqrt("size")).over(up)))
    first = F.max(F.when(F.col("rate") * F.sqrt("size") < 1, F.struct("size", "rate", "rest")))
    return (sizes.groupBy("of").agg(first.alias("at"))
            .select("of", F.col("at.size").alias("open"), "at.rate", "at.rest"))


def sampling_bounds(rows: DataFrame, weights: tuple[float, ...], share: float,
                    most: float) -> DataFrame:
    """What decides a source's documents: its target, its whole copies, its inclusions, and
    the rank of the last document drawn. One row per source, from numbered rows.

    The prefix sum of words along the ranks is found in cells: words per (source, cell)
    give the cell in which the remainder is reached, cells of that cell narrow it down
    again, and only the documents of the last cell are put in order. No source is ever
    sorted whole, however large.
    """
    targets = stored(
        source_targets(rows, weights, share, most)
        .withColumn("whole", F.when(F.col("source_size") > 0, F.floor(
            F.col("target") / F.col("source_size"))).otherwise(0).cast("int"))
        .withColumn("rest", F.col("target") - F.col("whole") * F.col("source_size"))
        .withColumnRenamed("source", "of"), "targets")
    targets = stored(targets.drop("rest").withColumnRenamed("of", "source")
                     .join(inclusions(rows, targets), same(), "left").drop("of"), "inclusions")
    drawn = (ranked(rows.join(targets.withColumnRenamed("source", "of"), same()))
             .where("drawn").drop("of").withColumn("before", F.lit(0).cast("long")))
    first = reached(drawn, "coarse")
    inside = (drawn.drop("before").join(first, same()).where("coarse = last")
              .withColumn("before", F.col("words_before")).drop("of", "last", "words_before"))
    second = reached(inside, "fine")
    upto = F.col("words_before") + F.sum("size").over(
        Window.partitionBy("source").orderBy(*TIES)
        .rowsBetween(Window.unboundedPreceding, 0))
    edge = (inside.drop("before").join(second, same()).where("fine = last")
            .withColumn("upto", upto)
            # A document that crosses the remainder stays if that comes nearer to it.
            .where((F.col("upto") - F.col("rest")) <= F.col("size") / 2)
            .groupBy("source").agg(F.max(F.struct(*TIES)).alias("limit")))
    known = targets.withColumnRenamed("source", "of")
    for found, column in ((first.withColumnRenamed("of", "source"), "last c1"),
                          (second.withColumnRenamed("of", "source"), "last c2"),
                          (edge, "limit limit")):
        old, new = column.split()
        known = known.join(found.select("source", F.col(old).alias(new)), same(), "left").drop("source")
    return stored(known, "bounds")


def same() -> Column:
    return F.expr("source <=> of")

TIES = ["rank", "key", "number"]


def ranked(frame: DataFrame) -> DataFrame:
    """Adds whether a document is certain or drawn for, its inclusion, its rank and its cells;
    only sizes above 0 are drawn."""
    drawn = (F.col("size") > 0) & (F.col("size") <= F.col("open")) & (F.col("inclusion") > 1e-12)
    # Without a remainder nothing is drawn; 0.5 only keeps the formula defined.
    rank = pareto_rank(uniform(F.col("key"), F.col("number")),
                       F.when(F.col("drawn"), F.col("inclusion")).otherwise(0.5))
    return (frame.withColumn("certain", F.col("size") > F.col("open"))
            .withColumn("inclusion", F.when(F.col("certain"), 1.0)
                        .otherwise(F.col("rate") * F.sqrt("size")))
            .withColumn("drawn", F.coalesce(drawn, F.lit(False))).withColumn("rank", rank)
            .withColumn("coarse", F.floor(F.col("rank") * CELLS))
            .withColumn("fine", F.floor((F.col("rank") * CELLS - F.col("coarse")) * CELLS)))


def reached(drawn: DataFrame, cell: str) -> DataFrame:
    """(of, last, words_before): the cell where a source's words pass its remainder."""
    upto = F.col("before") + F.sum("words").over(
        Window.partitionBy("source").orderBy(cell).rowsBetween(Window.unboundedPreceding, 0))
    words = (drawn.groupBy("source", cell)
             .agg(F.sum("size").alias("words"), F.first("rest").alias("rest"),
                  F.first("before").alias("before")).withColumn("upto", upto))
    return stored(
        words.where("upto > rest").groupBy("source")
        .agg(F.min(F.struct(F.col(cell).alias("last"), (F.col("upto") - F.col("words")).alias(
            "words_before"))).alias("at"))
        .select(F.col("source").alias("of"), "at.last", "at.words_before"), "cells")


def with_copies(docs: DataFrame, weights=(5.0, 2.0, 1.0), share=1.5, most=2.0,
                seed="mix", carry: bool = True) -> DataFrame:
    """doc_id, source, size, source_size, target, inclusion, copies and, if asked for, the
    input row as ``row``."""
    sized = docs.select("doc_id", "source", word_count("text").alias("size"),
                        key_of(F.col("doc_id"), F.col("text"), seed).alias("key"),
                        *([F.struct(*docs.columns).alias("row")] if carry else []))
    sizes = stored(sized.drop("row"), "sizes")
    repeated = repeated_keys(sizes)
    rows = told_apart(sizes, repeated)
    bounds = sampling_bounds(rows, weights, share, most)
    all_rows = told_apart(sized, repeated) if carry else rows
    taken = (F.when(~F.col("drawn"), F.col("certain")).when(F.col("c1").isNull(), True)
             .when(F.col("coarse") != F.col("c1"), F.col("coarse") < F.col("c1"))
             .when(F.col("c2").isNull(), True)
             .when(F.col("fine") != F.col("c2"), F.col("fine") < F.col("c2"))
             .otherwise(F.coalesce(F.struct(*TIES) <= F.col("limit"), F.lit(False))))
    return (ranked(all_rows.join(bounds, same()))
            .withColumn("copies", F.when(F.col("size") > 0, F.col("whole") + taken.cast("int"))
                        .otherwise(0))
            .select("doc_id", "source", "size", "source_size", "target", "inclusion", "copies",
                    *(["row"] if carry else [])))


def mix_table(docs: DataFrame) -> DataFrame:
    """The mix of a documents table, one row per document."""
    return with_copies(docs, carry=False).select(
        "doc_id", "size", "source_size", "target",
        (F.col("size") * F.col("copies")).cast("long").alias("taken"))


def mix(docs: DataFrame, **how) -> DataFrame:
    """The documents as the mix has them: a row per copy taken, all columns kept. Documents
    without words are not part of it; an empty table stays empty."""
    copies = F.explode(F.array_repeat(F.lit(1), F.col("copies")))
    return (with_copies(docs, **how).where("copies > 0").select("row", copies.alias("copy"))
            .select("row.*"))


SQL = """
WITH e AS (
  SELECT doc_id, source,
    coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0)::BIGINT AS size,
    md5('mix:' || coalesce(doc_id::VARCHAR, '') || ':' || md5(coalesce(text, ''))) AS key
  FROM documents),
n AS (SELECT *, row_number() OVER (PARTITION BY source, key) - 1 AS number FROM e),
d AS (
  SELECT *, (('0x' || substr(md5(key || ':' || number::VARCHAR), 1, 12))::BIGINT::DOUBLE + 0.5)
      / 281474976710656.0 AS u
  FROM n),
s AS (
  SELECT source, sum(size)::BIGINT AS source_size,
    row_number() OVER (ORDER BY source NULLS LAST) - 1 AS place FROM d GROUP BY source),
w AS (SELECT *, CASE place % 3 WHEN 0 THEN 5.0 WHEN 1 THEN 2.0 ELSE 1.0 END::DOUBLE AS weight FROM s),
r AS (SELECT *, 2.0::DOUBLE * source_size AS cap, 2.0::DOUBLE * source_size / weight AS ratio,
    1.5::DOUBLE * sum(source_size) OVER () AS mass FROM w),
l AS (
  SELECT *, (mass - (sum(cap) OVER f - cap)) / (sum(weight) OVER () - sum(weight) OVER f + weight)
    AS level
  FROM r WINDOW f AS (ORDER BY ratio, place ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
o AS (SELECT level FROM l WHERE level < ratio ORDER BY ratio, place LIMIT 1),
t AS (
  SELECT source, source_size,
    CASE WHEN (SELECT count(*) FROM o) = 0 THEN cap
      ELSE least(cap, weight * (SELECT level FROM o)) END AS target FROM l),
g AS (
  SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END AS whole FROM t),
-- How often a source has each size, and what is left for sizes up to it if larger ones are certain.
h AS (
  SELECT d.source, d.size, any_value(g.target - g.whole * g.source_size)
      - (sum(sum(d.size)) OVER (PARTITION BY d.source ORDER BY d.size DESC) - sum(d.size))::DOUBLE AS rest,
    sum(sum(d.size) * sqrt(d.size)) OVER (PARTITION BY d.source ORDER BY d.size) AS weight
  FROM d JOIN g ON d.source IS NOT DISTINCT FROM g.source WHERE d.size > 0 GROUP BY d.source, d.size),
i AS (
  SELECT source, max(size) AS open, arg_max(rest / weight, size) AS rate, arg_max(rest, size) AS rest
  FROM h WHERE rest / weight * sqrt(size) < 1 GROUP BY source),
k AS (
  SELECT d.*, g.source_size, g.target, g.whole, i.rest, d.size > i.open AS certain,
    d.size > 0 AND d.size <= i.open AND i.rate * sqrt(d.size) > 1e-12 AS drawn,
    CASE WHEN d.size > 0 AND d.size <= i.open AND i.rate * sqrt(d.size) > 1e-12
      THEN i.rate * sqrt(d.size) ELSE 0.5 END AS p
  FROM d JOIN g ON d.source IS NOT DISTINCT FROM g.source
    LEFT JOIN i ON d.source IS NOT DISTINCT FROM i.source),
c AS (
  SELECT *, sum(CASE WHEN drawn THEN size ELSE 0 END) OVER (
    PARTITION BY source ORDER BY (u / (1 - u)) / (p / (1 - p)), key, number
    ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS upto FROM k)
SELECT doc_id, size, source_size, target,
  (size * CASE WHEN size = 0 THEN 0 ELSE whole + CASE WHEN certain OR drawn AND upto - rest <= size / 2.0
    THEN 1 ELSE 0 END END)::BIGINT AS taken
FROM c
"""
