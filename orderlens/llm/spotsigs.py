"""Document fingerprints by SpotSigs: what follows the common words.

A text's words are lower-cased runs of letters and digits. Common words are anchors, as is
the start of the text; the chain of the next ``two`` content words after an anchor is a
signature, and the fingerprint of a text is the set of its signatures. Where no common word
after the start gives a chain, the start alone would stand for a text of any length; there
every content word starts a chain, so that the signatures cover the whole text, if it has
more than five content words. Likeness is the Jaccard similarity of two sets.

Sets of a likeness of t or more differ in size by a factor of t at most. So sets fall into
length partitions of that ratio, and a pair is pruned if its partitions are neither equal nor
neighbours, if its sizes cannot reach t, or if it shares no signature; what is left is
compared in full. ``near_pairs`` finds all pairs of a corpus that way. ``edits_table`` is asked
for the likeness of given pairs, however low (t = 0): it has no partitions, and only pairs
without a shared signature are pruned.

Everything is DataFrame functions: no Python runs on the executors.

Defined cases: a missing text is empty; a text of at most one content word has the whole
sequence as its only signature; a text without words has no signature, and two such texts
have likeness 1; equal texts have equal fingerprints; a missing doc_id counts as the
smallest; rows that agree in doc_id and text are one document and give equal rows; the next
document of the last one is the first.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from orderlens.llm.common import numbered, stored, whole_texts

# Common words of English, German, French and Spanish.
ANCHORS = (
    "the of and to in a is that it for on was with as be by this are at from or "
    "der die das und ist den von zu mit sich des auf ein eine nicht dem "
    "le la les et un une des du que est en dans pour pas il sur "
    "el los las y del por con se no una su al lo").split()
#: Marks in a normalised text: an anchor, and a content word that follows one.
ANCHOR, FOLLOWS = "\u0001", "\u0002"
KEY = ["did", "h"]
#: The start's chain alone stands for a text without other chains up to as many content words.
SHORT = 5


def signatures(text: Column) -> Column:
    """The text's signature set as hashed longs."""
    words = F.concat(F.lit(f" {ANCHOR} "), F.regexp_replace(
        F.lower(text), r"[^\p{L}\p{N}]+", " "), F.lit(" "))
    common = "|".join(sorted(set(ANCHORS)))
    marked = F.regexp_replace(words, f"(?<= )(?:{common})(?= )", ANCHOR)
    content = F.regexp_replace(marked, f"[ {ANCHOR}]*{ANCHOR}[ {ANCHOR}]*", f" {FOLLOWS}")
    chain = f"(?=([^ {FOLLOWS}]+ {FOLLOWS}?[^ {FOLLOWS}]+))"
    chains = F.regexp_extract_all(content, F.lit(f"{FOLLOWS}{chain}"), 1)
    every = F.regexp_extract_all(content, F.lit(f"(?<=[ {FOLLOWS}])(?=[^ {FOLLOWS}]){chain}"), 1)

    def hashed(found: Column) -> Column:
        return F.array_distinct(F.transform(found, lambda c: F.xxhash64(F.translate(c, FOLLOWS, ""))))

    only = F.trim(F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}]+", " "))
    # The first chain is that of the start.
    return (F.when(F.size(chains) > 1, hashed(chains))
            .when(F.size(every) >= SHORT, hashed(every))
            .when(F.size(chains) > 0, hashed(chains))
            .when(only != "", F.array(F.xxhash64(only)))
            .otherwise(F.array().cast("array<bigint>")))


def fingerprint(sigs: Column) -> Column:
    """32 hex digits that are equal for equal signature sets."""
    return F.md5(F.array_join(F.sort_array(sigs).cast("array<string>"), ",").cast("binary"))


def length_partition(sigs: Column, least: float) -> Column:
    """Number of the length partition: each spans sizes within a factor of ``least``."""
    return F.floor(F.log(F.greatest(F.size(sigs), F.lit(1))) / F.lit(-math.log(least)) + 1e-9).cast("int")


def likeness(a: Column, b: Column, least: float = 0.0) -> Column:
    """Jaccard similarity, or 0 where that is sure to be below ``least``."""
    small, large = F.least(F.size(a), F.size(b)), F.greatest(F.size(a), F.size(b))
    far = F.lit(False)
    if least > 0:
        far = ((F.abs(length_partition(a, least) - length_partition(b, least)) > 1)
               | (small < F.lit(least) * large))
    shared = F.size(F.array_intersect(a, b))
    return (F.when(large == 0, 1.0)
            .when(far | (small == 0) | ~F.arrays_overlap(a, b), 0.0)
            .otherwise(shared / (F.size(a) + F.size(b) - shared)).cast("double"))


def near_pairs(docs: DataFrame, least: float = 0.8) -> DataFrame:
    """fingerprint_a, fingerprint_b, near: every pair of different signature sets with a
    likeness of ``least`` or more (between 0 and 1), the smaller set first.

    Equal sets are one. Each posts its rarest signatures only: a set of n shares at least
    least * n of them with a like one, so among the n - least * n + 1 rarest is a shared one.
    Postings meet by signature inside equal and neighbouring length partitions.
    """
    sets = stored(
        whole_texts(docs).select(signatures(F.col("text")).alias("sigs")).where(F.size("sigs") > 0)
        .select(fingerprint(F.col("sigs")).alias("fp"), F.sort_array("sigs").alias("sigs"))
        .dropDuplicates(["fp"]), "sets")
    posted = sets.select("fp", F.size("sigs").alias("n"), length_partition(F.col("sigs"), least).alias("part"),
                         F.explode("sigs").alias("sig"))
    rarest = F.row_number().over(Window.partitionBy("fp").orderBy("often", "sig"))
    often = posted.groupBy("sig").agg(F.count("*").alias("often"))
    postings = stored(posted.join(often, "sig").withColumn("place", rarest)
                      .where(F.expr("place <= n") & (F.col("place") <= F.col("n") + 1 - F.ceil(
                          F.lit(least) * F.col("n") - 1e-9))).select("fp", "n", "part", "sig"), "postings")
    small = postings.select(F.col("fp").alias("a"), F.col("n").alias("n_a"), "sig",
                            F.explode(F.array("part", F.col("part") + 1)).alias("part"))
    large = postings.withColumnsRenamed({"fp": "b", "n": "n_b"})
    met = (small.join(large, ["sig", "part"])
           .where("n_a < n_b OR n_a = n_b AND a < b")
           .where(F.col("n_a") >= F.lit(least) * F.col("n_b") - 1e-9).select("a", "b").distinct())
    return (met.join(sets.select(F.col("fp").alias("a"), F.col("sigs").alias("sigs_a")), "a")
            .join(sets.select(F.col("fp").alias("b"), F.col("sigs").alias("sigs_b")), "b")
            .select(F.col("a").alias("fingerprint_a"), F.col("b").alias("fingerprint_b"),
                    likeness(F.col("sigs_a"), F.col("sigs_b")).alias("near"))
            .where(F.col("near") >= least))


def smallest() -> Column:
    """Stands for a missing doc_id."""
    return F.lit(-(1 << 63)).cast("long")


def identified(docs: DataFrame) -> DataFrame:
    return whole_texts(docs).withColumn("did", F.coalesce("doc_id", smallest())).withColumn(
        "h", F.xxhash64("text"))


def neighbours(texts: DataFrame) -> DataFrame:
    """did, h and length of every document, and of the one before it in the order of did."""
    rows = stored(numbered(texts.select(*KEY, F.char_length("text").alias("n")).distinct(), KEY), "order")
    last = rows.agg(F.max("rn")).scalar()
    after = rows.select(F.col("did").alias("did_before"), F.col("h").alias("h_before"),
                        F.col("n").alias("n_before"),
                        F.when(F.col("rn") == last, 0).otherwise(F.col("rn") + 1).alias("rn"))
    return rows.join(after, "rn").drop("rn")


def edits_table(docs: DataFrame) -> DataFrame:
    """Each document beside its edited text, whose last quarter is the start of the next
    document's text, and beside the next document.

    A document sends the one before it no more than that start and its signatures.
    """
    # Both sides read the same columns of the texts, so that one shuffle of them serves both.
    texts = identified(docs).select(*KEY, "text")
    placed = texts.join(stored(neighbours(texts), "neighbours"), KEY)
    one = F.row_number().over(Window.partitionBy(*KEY).orderBy(*KEY))
    sent = (placed.withColumn("copy", one).where("copy = 1").select(
        F.col("did_before").alias("did"), F.col("h_before").alias("h"),
        F.substring("text", F.lit(1), F.floor(F.col("n_before") / 4).cast("int")).alias("start"),
        signatures(F.col("text")).alias("next_sigs")))
    kept = F.substring("text", F.lit(1), (F.col("n") - F.floor(F.col("n") / 4)).cast("int"))
    beside = (placed.select(*KEY, "n", "text", signatures(F.col("text")).alias("sigs"))
              .join(sent, KEY)
              .select(F.nullif("did", smallest()).alias("doc_id"), F.col("n").cast("long").alias("n_chars"), "sigs", "next_sigs",
                      F.concat(kept, "start").alias("edited"))
              .select("doc_id", "n_chars", "sigs", "next_sigs",
                      F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"),
                      signatures(F.col("edited")).alias("edited_sigs")))
    return beside.select(
        "doc_id", "n_chars", "edited_sha256", fingerprint(F.col("sigs")).alias("fingerprint"),
        fingerprint(F.col("edited_sigs")).alias("edited_fingerprint"),
        likeness(F.col("sigs"), F.col("edited_sigs")).alias("near_edited"),
        likeness(F.col("sigs"), F.col("next_sigs")).alias("near_next"))
