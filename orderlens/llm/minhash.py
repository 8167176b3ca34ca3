"""Near-duplicates by SuperMinHash signatures, banding, verification and grouping.

Every element of a set draws its own random permutation of the signature's slots. The slot that
comes at rank j of the permutation is offered j plus a random fraction, and a slot keeps the
least offer of all elements. Ranks are gone through in step, first rank 0 of all elements, then
rank 1: an offer of a later rank never beats an earlier one, so a document stops as soon as
all its slots are filled. That is after one rank for a long text and after about 600 offers for a
short one. The slots of a document share its permutations, which is what lowers the variance
against independent hash functions.

Four neighbouring slots make a band. Sets that agree in a band meet in its bucket; with 32 bands
a pair of similarity 0.85 is missed with a chance of (1 - 0.85^4)^32, about 6 in 10^11. Equal sets
are folded to one class before any of this. In a bucket every class is compared with one of
them, the head, so a bucket whose classes are all alike costs one comparison a class. Classes
of buckets that still hold several groups are dealt anew, by their rare shingles, which parts
the many that are similar without reaching the limit (``rare_buckets``); there they are compared
with more heads each round, but only across the groups that the links found so far leave apart. A
pair is left out only once a chain of links joins it, or it was compared, or its rare shingles
or parity bits rule it out: every class keeps the parity of its shingles per hashed slot, and two
sets differ in at least as many shingles as these bits differ. So of a large group of copies that
are alike without reaching the limit, few pairs remain to be compared. Comparisons are exact, on the
full shingle sets made anew from the texts; the sets of one head and of one other class are in
memory at a time, and a crowded head is dealt to many tasks.

Defined cases: a missing text, an empty one or one of white space has an empty set, no link and
itself as component; equal rows share everything; a document without doc_id takes part, but
names a component only where no document in it has an id, and is then kept; an empty table gives no rows;
other columns are ignored.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from orderlens.llm.common import in_arrow, stored, whole_texts
from orderlens.llm.graph import components

SLOTS, BAND = 128, 4
#: 64-bit words of parity bits a class keeps.
PARITY = 16
#: Heads a crowded bucket is compared with in the first round, and how many times more in each next one.
HEADS, MORE = 32, 64
#: Comparisons with one head that a task makes before the head is dealt to one more.
DEALT = 256
#: Bytes of a text, and elements of sets, that are worked on at once.
PIECE, ELEMENTS = 1 << 18, 1 << 16
#: Words of more bytes are hashed on their own.
LONG = 1024

SPACE = re.compile(rb"[ \t-\r]")
ODD = np.uint64(0x9E3779B97F4A7C15)
MIX = np.uint64(0xBF58476D1CE4E5B9)
UNSET = np.uint64(2 ** 64 - 1)


def scattered(x: np.ndarray) -> np.ndarray:
    """Bits mixed so that each depends on all."""
    x = (x ^ (x >> np.uint64(30))) * MIX
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def powers(base: int, n: int) -> np.ndarray:
    """base ** 0 to base ** (n - 1), modulo 2 ** 64."""
    factors = np.full(n, base, np.uint64)
    factors[0] = 1
    return np.cumprod(factors, dtype=np.uint64)


#: Bytes as numbers, capitals as their small letters; and what a byte's place multiplies it by.
SPACES = np.isin(np.arange(256), [9, 10, 11, 12, 13, 32])
LETTERS = scattered((np.frombuffer(bytes(range(256)).lower(), np.uint8).astype(np.uint64) + np.uint64(1)) * ODD)
PLACES, UNPLACED = powers(int(MIX), 2 * PIECE), powers(pow(int(MIX), -1, 2 ** 64), 2 * PIECE)


def word_hashes(text: bytes) -> np.ndarray:
    """64-bit hashes of the lower-cased words of a piece of text, in order: polynomials of their
    bytes, from running sums over the piece. Long words are hashed one by one.
    """
    codes = np.frombuffer(text, np.uint8)
    inside = ~SPACES[codes]
    edges = np.flatnonzero(np.diff(inside, prepend=False, append=False))
    starts, ends = edges[::2], edges[1::2]
    if len(codes) > 2 * PIECE:  # one word
        out = np.zeros(len(starts), np.uint64)
    else:
        sums = np.zeros(len(codes) + 1, np.uint64)
        np.cumsum(LETTERS[codes] * PLACES[:len(codes)], out=sums[1:])
        out = (sums[ends] - sums[starts]) * UNPLACED[starts]
    for k in np.flatnonzero(ends - starts > LONG):
        out[k] = xxhash.xxh64_intdigest(text[starts[k]:ends[k]].lower())
    return scattered(out + (ends - starts).astype(np.uint64) * ODD)


def pieces(text: bytes):
    """The text cut at white space: pieces of up to twice PIECE bytes, or one longer word."""
    start = 0
    while start < len(text):
        cut = SPACE.search(text, start + PIECE)
        end = cut.start() if cut else len(text)
        if end - start > 2 * PIECE:
            last = next((k for k in range(start + PIECE - 1, start - 1, -1) if SPACES[text[k]]), start)
            yield text[start:last]
            start = last
        yield text[start:end]
        start = end


def shingle_set(text: bytes, size: int = 5) -> np.ndarray:
    """Sorted distinct hashes of the shingles of ``size`` words; of the whole sequence where
    there are fewer words; none without words.
    """
    words = np.concatenate([word_hashes(piece) for piece in pieces(text)] or [np.empty(0, np.uint64)])
    n = min(len(words), size)
    if not n:
        return words
    out = np.full(len(words) - n + 1, n, np.uint64)
    for k in range(n):
        out = scattered(out * ODD + words[k:k + len(out)])
    out.sort()
    return out[np.append(True, out[1:] != out[:-1])]


def drawn(elements: np.ndarray, rank: int, slots: int) -> tuple[np.ndarray, np.ndarray]:
    """What the elements draw at a rank: the position to exchange with, and the offer."""
    bits = scattered(elements + np.uint64((rank + 1) * int(ODD) % 2 ** 64))
    place = np.uint64(rank) + (((bits & np.uint64(0xFFFFFFFF)) * np.uint64(slots - rank)) >> np.uint64(32))
    return place.astype(np.int64), (bits >> np.uint64(32)) | np.uint64(rank << 32)


def signatures(sets: list[np.ndarray], slots: int = SLOTS) -> np.ndarray:
    """SuperMinHash signatures of non-empty sets, a row each."""
    out = np.full((len(sets), slots), UNSET)
    for row, elements in enumerate(sets):
        for start in range(0, len(elements), 16 * ELEMENTS):
            place, offer = drawn(elements[start:start + 16 * ELEMENTS], 0, slots)
            np.minimum.at(out[row], place, offer)
    waiting = np.flatnonzero((out == UNSET).any(axis=1))
    while len(waiting):
        sizes = np.cumsum([len(sets[k]) for k in waiting])
        now = waiting[:max(1, int(np.searchsorted(sizes, ELEMENTS)))]
        waiting = waiting[len(now):]
        out[now] = later_ranks([sets[k] for k in now], out[now], slots)
    return out


def later_ranks(sets: list[np.ndarray], out: np.ndarray, slots: int) -> np.ndarray:
    """Goes on from rank 1 until every slot of every set is filled."""
    elements = np.concatenate(sets)
    owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    order = np.tile(np.arange(slots, dtype=np.uint8 if slots <= 256 else np.uint16), (len(elements), 1))
    row = np.arange(len(elements))
    for rank in range(slots):
        place, offer = drawn(elements, rank, slots)
        slot = order[row, place]
        order[row, place] = order[:, rank]
        order[:, rank] = slot
        if rank:
            np.minimum.at(out, (owner, slot), offer)
            going = (out == UNSET).any(axis=1)[owner]
            if not going.any():
                break
            if going.sum() * 2 < len(row):
                elements, owner, order = elements[going], owner[going], order[going]
                row = np.arange(len(elements))
    return out


def band_keys(signature: np.ndarray, band: int = BAND) -> np.ndarray:
    """One key for every band of every row; the number of the band is part of it."""
    groups = signature.reshape(len(signature), -1, band)
    out = np.broadcast_to(np.arange(groups.shape[1], dtype=np.uint64), groups.shape[:2])
    for k in range(band):
        out = scattered(out * ODD + groups[:, :, k])
    return out.view(np.int64)


def parity(elements: np.ndarray) -> np.ndarray:
    """For each of 64 * PARITY slots whether an odd number of elements falls into it."""
    counts = np.bincount((elements % np.uint64(64 * PARITY)).astype(np.int64), minlength=64 * PARITY)
    return np.packbits((counts & 1).astype(np.uint8)).view(np.int64)


def prints(docs: DataFrame, size: int = 5) -> DataFrame:
    """doc_id, text_key, n (set size), key (of the set), bands, parity bits of every document."""
    per_row = SLOTS // BAND

    def work(batch):
        sizes, keys, sets, bands, bits, held = [], [], [], [], [], 0
        for text in batch.column(1).cast(pa.binary()):
            one = shingle_set(text.as_py(), size)
            sizes.append(len(one))
            keys.append(xxhash.xxh128_digest(one.tobytes()))
            bits.append(parity(one))
            if len(one):
                sets.append(one)
                held += len(one)
            if held > 16 * ELEMENTS:
                bands.append(band_keys(signatures(sets)))
                sets, held = [], 0
        if sets:
            bands.append(band_keys(signatures(sets)))
        ends = np.cumsum([0] + [per_row * (n > 0) for n in sizes])
        flat = np.concatenate(bands).ravel() if bands else np.empty(0, np.int64)
        return {"doc_id": batch.column(0), "text_key": batch.column(2), "n": sizes, "key": keys,
                "bands": pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat, pa.int64())),
                "bits": bits}

    return in_arrow(keyed(docs), work,
                    "doc_id long, text_key long, n long, key binary, bands array<long>, bits array<long>")


def keyed(docs: DataFrame) -> DataFrame:
    return whole_texts(docs).withColumn("text_key", F.xxhash64("text"))


def confirmed(pairs: DataFrame, texts: DataFrame, size: int, percent: int) -> DataFrame:
    """The (a, b) pairs whose shingle sets have 100 * intersection >= percent * union."""
    def check(batches):
        head, memo, held = None, {}, 0
        for batch in batches:
            found_a, found_b = [], []
            for a, role, cid, text in zip(*(batch.column(c) for c in ("a", "role", "cid", "text"))):
                one = memo.get(cid.as_py())
                if one is None:
                    one = shingle_set(text.as_py().encode(), size)
                    held += len(one)
                    if held > 32 * ELEMENTS:
                        memo, held = {}, len(one)
                    memo[cid.as_py()] = one
                if role.as_py() == 0:
                    head = one
                    continue
                at = np.minimum(np.searchsorted(head, one), len(head) - 1)
                common = int((head[at] == one).sum())
                if 100 * common >= percent * (len(head) + len(one) - common):
                    found_a.append(a.as_py())
                    found_b.append(cid.as_py())
            yield pa.RecordBatch.from_pydict({"a": pa.array(found_a, pa.int64()),
                                              "b": pa.array(found_b, pa.int64())})

    parts = pairs.groupBy("a").agg(F.ceil(F.count("*") / DEALT).alias("parts"))
    dealt = pairs.join(parts, "a").withColumn("part", F.pmod(F.xxhash64("b"), F.col("parts")))
    asked = (dealt.select("a", "part", F.lit(0).alias("role"), F.col("a").alias("cid")).distinct()
             .unionAll(dealt.select("a", "part", F.lit(1), "b")))
    return (asked.join(texts, "cid").repartition("a", "part").sortWithinPartitions("a", "part", "role")
            .select("a", "role", "cid", "text").mapInArrow(check, "a long, b long"))


def fitting(a: str, b: str, percent: int):
    """Sets of these sizes can be that similar at all."""
    return F.least(a, b) * 100 >= F.greatest(a, b) * percent


def near_enough(n: str, other_n: str, bits: str, other_bits: str, percent: int):
    """The parity bits leave it open that the sets are that similar: they share enough only if they
    differ in few shingles, and they differ in at least as many as their bits do.
    """
    differing = sum(F.bit_count(F.col(bits)[k].bitwiseXOR(F.col(other_bits)[k])) for k in range(PARITY))
    return differing * (100 + percent) <= (F.col(n) + F.col(other_n)) * (100 - percent)


def grouped(classes: DataFrame, texts_of, size: int, percent: int) -> DataFrame:
    """(cid, root) of the classes (cid, n, bands, bits) that any link reaches; texts_of gives (cid,
    text) of a table of cids.
    """
    keys = classes.select("cid", "n", F.explode("bands").alias("bucket"))
    heads = (keys.groupBy("bucket").agg(F.min(F.struct("cid", "n")).alias("head"), F.count("*").alias("k"))
             .where("k > 1").select("bucket", "head"))
    members = stored(keys.join(heads, "bucket").where("cid <> head.cid"), "buckets")
    named = members.select("cid").unionAll(members.select("head.cid")).distinct()
    texts = stored(texts_of(named), "texts")

    met = members.where(fitting("n", "head.n", percent)).select(
        F.col("head.cid").alias("a"), F.col("cid").alias("b")).distinct()
    kept = [classes.select(F.col("cid").alias(c), F.col("n").alias(f"n_{c}"), F.col("bits").alias(f"bits_{c}"))
            for c in ("a", "b")]
    tested = stored(met.join(kept[0], "a").join(kept[1], "b")
                    .where(near_enough("n_a", "n_b", "bits_a", "bits_b", percent)).select("a", "b"), "pairs")
    roots = components(stored(confirmed(tested, texts, size, percent), "links"))
    left = stored(apart(members.select("bucket", "cid", "n"), roots), "apart")
    if left.isEmpty():
        return roots.select(F.col("node").alias("cid"), "root")
    left, heads_now = apart(rare_buckets(left, texts, size, percent), roots), HEADS
    left = stored(left.join(classes.select("cid", "bits"), "cid"), "crowded")
    while not left.isEmpty():
        place = F.row_number().over(Window.partitionBy("bucket").orderBy("cid"))
        first = stored(left.withColumn("nth", place).where(F.col("nth") <= heads_now).drop("nth"), "heads")
        heads = first.select("bucket", *[F.col(c).alias(f"head_{c}") for c in ("cid", "n", "place", "root", "bits")])
        # Of the shingles two sets share, the first in order has all the others behind it.
        most = F.least(F.col("n") - F.col("place"), F.col("head_n") - F.col("head_place")) + 1
        enough = most * (100 + percent) >= (F.col("n") + F.col("head_n")) * percent
        pairs = (left.join(heads, "bucket")
                 .where((F.col("cid") > F.col("head_cid")) & (F.col("root") != F.col("head_root")) & enough
                        & near_enough("n", "head_n", "bits", "head_bits", percent))
                 .select(F.col("head_cid").alias("a"), F.col("cid").alias("b")).distinct())
        new = stored(pairs.join(tested, ["a", "b"], "left_anti"), "pairs")
        links = stored(confirmed(new, texts, size, percent), "links")
        tested = tested.unionAll(new)
        if not links.isEmpty():
            roots = regrouped(roots, links)
        last = first.groupBy("bucket").agg(F.max("cid").alias("last"))
        left = stored(apart(left.join(last, "bucket").where("cid > last").drop("last", "root"), roots), "apart")
        heads_now *= MORE
    return roots.select(F.col("node").alias("cid"), "root")


def apart(members: DataFrame, roots: DataFrame) -> DataFrame:
    """The members (bucket, cid) of the buckets that hold several groups, with their root."""
    held = members.join(roots.withColumnRenamed("node", "cid"), "cid", "left").withColumn(
        "root", F.coalesce("root", "cid"))
    several = (held.groupBy("bucket").agg(F.min("root").alias("lo"), F.max("root").alias("hi"))
               .where("lo <> hi").select("bucket"))
    return held.join(several, "bucket")


def rare_buckets(members: DataFrame, texts: DataFrame, size: int, percent: int) -> DataFrame:
    """(bucket, cid, n, place): the same classes dealt anew, by rare shingles. Two sets of the wanted
    similarity share most of their shingles, so, with all in order of how many of the classes
    hold them, they share one among the first n - ceil(percent * n / 100) + 1 of each. Shingles of
    one class only come first and need no bucket: sets that differ in too many of them have none.
    """
    def spread(batch):
        sets = [shingle_set(text.as_py(), size) for text in batch.column(1).cast(pa.binary())]
        sizes = [len(s) for s in sets]
        return {"cid": np.repeat(batch.column(0).to_numpy(), sizes), "n": np.repeat(sizes, sizes).astype(np.int64),
                "bucket": np.concatenate(sets or [np.empty(0, np.uint64)]).view(np.int64)}

    wanted = texts.join(members.select("cid").distinct(), "cid", "left_semi").select("cid", "text")
    shingles = stored(in_arrow(wanted, spread, "cid long, n long, bucket long", rows=64), "shingles")
    held = shingles.groupBy("bucket").agg(F.count("*").alias("held")).where("held > 1")
    one = Window.partitionBy("cid")
    place = F.row_number().over(one.orderBy("held", "bucket")) + F.col("n") - F.count("*").over(one)
    return (shingles.join(held, "bucket").withColumn("place", place)
            .where(F.col("place") <= F.col("n") - F.ceil(F.col("n") * percent / 100) + 1)
            .select("bucket", "cid", "n", "place"))


def regrouped(roots: DataFrame, links: DataFrame) -> DataFrame:
    """The (node, root) rows once more links are known: whole groups are linked."""
    def lifted(ends, column):
        return (ends.join(roots.withColumnRenamed("node", column), column, "left")
                .withColumn(column, F.coalesce("root", column)).drop("root"))

    moved = components(lifted(lifted(links, "a"), "b"))
    old = roots.join(moved.select(F.col("node").alias("root"), F.col("root").alias("to")), "root", "left")
    old = old.select("node", F.coalesce("to", "root").alias("root"))
    return stored(old.unionAll(moved.join(roots, "node", "left_anti").select("node", "root")), "roots")


def near_duplicates(docs: DataFrame, size: int = 5, percent: int = 85) -> DataFrame:
    """doc_id, n_shingles, component_id and kept of every document: linked are documents whose
    shingle sets have 100 * intersection >= percent * union, a component is named by its smallest doc_id.
    """
    rows = stored(prints(docs, size), "prints")
    classes = stored(
        rows.where("n > 0").groupBy("key").agg(
            F.min("text_key").alias("text_key"), F.min("doc_id").alias("doc_id"),
            F.first("n").alias("n"), F.first("bands").alias("bands"), F.first("bits").alias("bits"))
        .withColumn("cid", F.monotonically_increasing_id()), "classes")

    def texts_of(cids: DataFrame) -> DataFrame:
        # Copies are folded before the texts are moved.
        whole = keyed(docs).groupBy("text_key").agg(F.first("text").alias("text"))
        return whole.join(classes.select("cid", "text_key").join(cids, "cid"), "text_key").select("cid", "text")

    roots = grouped(classes.select("cid", "n", "bands", "bits"), texts_of, size, percent)
    rooted = classes.select("key", "cid", "doc_id").join(roots, "cid", "left").withColumn(
        "root", F.coalesce("root", "cid"))
    names = rooted.groupBy("root").agg(F.min("doc_id").alias("component_id"))
    known = stored(rooted.join(names, "root").select("key", "component_id"), "components")
    component = F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id"))
    return (rows.select("doc_id", "n", "key").join(known, "key", "left")
            .select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"),
                    component.eqNullSafe(F.col("doc_id")).alias("kept")))
