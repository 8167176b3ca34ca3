"""Near-duplicates by SimHash, linked by meet-in-the-middle ball hashing.

Two fingerprints that differ in at most 2h bits have a common variant within h bits of
each. Every fingerprint emits all variants within half the radius, the shuffle brings equal
variants together, and each pair that meets is verified by counting its differing bits.
An odd radius leaves one bit over: the 64 bits fall into three blocks, and the variants are
taken three times, with one block left out each time. One of the blocks holds a differing
bit, and without it the pair is within twice the half radius.

Only distinct fingerprints are hashed, so copies meet once. Inside a crowded variant pairs
are compared in memory and only a spanning forest of the links leaves the task.

Defined cases: a missing or empty text, or one of white space, has fingerprint zero and is
linked like any other; equal rows share fingerprint and component; a missing doc_id takes
part but names a component only if no document in it has an id; an empty table gives no rows.
"""

from __future__ import annotations

from itertools import accumulate, combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from orderlens.llm.common import in_arrow, stored, whole_texts
from orderlens.llm.graph import components

SEED = 42
#: In variants shared by more fingerprints than this, links leave as a spanning forest.
CROWD = 256


def fingerprint(text: bytes, size: int = 3) -> int:
    """Bits set in over half the XXH64 values of the text's word shingles, as a signed long."""
    words = text.lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    digest = xxhash.xxh64_digest
    if len(words) <= size:
        hashes = digest(joined, SEED)
    else:
        ends = list(accumulate(len(w) + 1 for w in words))
        hashes = b"".join([digest(joined[a:b - 1], SEED)
                           for a, b in zip([0] + ends, ends[size - 1:])])
    rows = np.frombuffer(hashes, dtype=np.uint8).reshape(-1, 8)
    ones = np.zeros(64, dtype=np.int64)
    for start in range(0, len(rows), 1 << 16):  # a piece at a time: texts may be very long
        ones += np.unpackbits(rows[start:start + (1 << 16)], axis=1).sum(axis=0, dtype=np.int64)
    return int(np.packbits(ones * 2 > len(rows)).view(">i8")[0])


def fingerprints(docs: DataFrame, size: int = 3, *more: str) -> DataFrame:
    """doc_id, fp and other string columns if asked for."""
    def work(batch):
        texts = batch.column(1).cast(pa.binary()).to_pylist()
        return {"doc_id": batch.column(0), "fp": [fingerprint(t, size) for t in texts],
                **{name: batch.column(name) for name in more}}

    return in_arrow(whole_texts(docs, *more), work,
                    ", ".join(["doc_id long, fp long", *[f"{name} string" for name in more]]))


def ball_masks(radius: int) -> list[tuple[int, np.ndarray]]:
    """(bits kept, flips) for each projection of the ball hashing of a radius."""
    half = radius // 2
    blocks = [range(0, 21), range(21, 42), range(42, 64)] if radius % 2 else [range(0)]
    out = []
    for block in blocks:
        kept = [b for b in range(64) if b not in block]
        flips = [sum(1 << b for b in some) for n in range(half + 1)
                 for some in combinations(kept, n)]
        out.append((sum(1 << b for b in kept), np.array(flips, dtype=np.uint64)))
    return out


def pairs_meeting(keys: np.ndarray, fps: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Verified links among fingerprints that share a variant; keys are sorted."""
    found_a, found_b = [], []
    at = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1], [True])))
    sizes = np.diff(at)
    small = np.repeat(sizes <= CROWD, sizes)
    here, step = np.flatnonzero(small), 1
    while len(here):
        here = here[here + step < len(keys)]
        here = here[keys[here] == keys[here + step]]
        a, b = fps[here], fps[here + step]
        near = np.bitwise_count(a ^ b) <= radius
        found_a.append(a[near])
        found_b.append(b[near])
        step += 1
    for start, size in zip(at[:-1][sizes > CROWD], sizes[sizes > CROWD]):
        a, b = forest(np.unique(fps[start:start + size]), radius)
        found_a.append(a)
        found_b.append(b)
    return np.concatenate(found_a or [fps[:0]]), np.concatenate(found_b or [fps[:0]])


def forest(fps: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of the links among distinct fingerprints: a walk that visits each
    once and compares it with those not reached yet.
    """
    waiting, a, b = fps, [], []
    while len(waiting):
        front, waiting = [waiting[0]], waiting[1:]
        while front and len(waiting):
            one = front.pop()
            near = np.bitwise_count(waiting ^ one) <= radius
            if near.any():
                reached = waiting[near]
                a.append(np.full(len(reached), one))
                b.append(reached)
                front.extend(reached)
                waiting = waiting[~near]
    return np.concatenate(a or [fps[:0]]), np.concatenate(b or [fps[:0]])


def links(distinct: DataFrame, radius: int = 3) -> DataFrame:
    """(a, b) links between distinct fingerprints (fp) within the radius."""
    masks = ball_masks(radius)

    def emit(batch):
        fps = batch.column(0).to_numpy().view(np.uint64)
        keys = [((fps & np.uint64(kept))[:, None] ^ flips[None, :]) for kept, flips in masks]
        return {"key": np.concatenate([k.ravel() for k in keys]).view(np.int64),
                "fp": np.concatenate([np.repeat(fps, k.shape[1]) for k in keys]).view(np.int64)}

    def meet(batches):
        keys, fps = np.empty(0, np.int64), np.empty(0, np.uint64)
        for batch in batches:
            keys = np.concatenate((keys, batch.column(0).to_numpy()))
            fps = np.concatenate((fps, batch.column(1).to_numpy().view(np.uint64)))
            # The last variant may go on in the next batch.
            cut = int(np.searchsorted(keys, keys[-1])) if len(keys) else 0
            if cut:
                yield verified(keys[:cut], fps[:cut])
                keys, fps = keys[cut:], fps[cut:]
        if len(keys):
            yield verified(keys, fps)

    def verified(keys, fps):
        a, b = pairs_meeting(keys, fps, radius)
        return pa.RecordBatch.from_pydict({"a": a.view(np.int64), "b": b.view(np.int64)})

    met = (in_arrow(distinct.select("fp"), emit, "key long, fp long")
           .repartition("key").sortWithinPartitions("key")
           .mapInArrow(meet, "a long, b long"))
    return met.distinct()


def rooted(prints: DataFrame, first: Column, radius: int) -> DataFrame:
    """fp, root and the least ``first`` of every distinct fingerprint; root is one
    fingerprint of its component.
    """
    classes = stored(prints.groupBy("fp").agg(F.min(first).alias("first")), "classes")
    # One class's own rows need no link: only different fingerprints are linked.
    roots = components(links(classes, radius))
    return (classes.join(roots.withColumnRenamed("node", "fp"), "fp", "left")
            .withColumn("root", F.coalesce("root", "fp")))


def near_duplicates(docs: DataFrame, size: int = 3, radius: int = 3) -> DataFrame:
    """doc_id, fingerprint and component_id of every document: the smallest doc_id that a
    chain of links reaches, itself included.
    """
    prints = stored(fingerprints(docs, size), "prints")
    named = rooted(prints, F.col("doc_id"), radius)
    names = named.groupBy("root").agg(F.min("first").alias("component_id"))
    known = stored(named.join(names, "root").select("fp", "component_id"), "components")
    return (prints.join(known, "fp")
            .select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"),
                    "component_id"))


def first_of_each(docs: DataFrame, size: int = 3, radius: int = 3) -> DataFrame:
    """One document of each component, all columns kept: the one with the smallest doc_id (a
    missing one is the last), of several texts under that id the one of least hash; of rows
    that agree in doc_id and text one stays.
    """
    # Neither doc_id nor text alone: ids may be missing or shared, and texts have many copies.
    one = F.sha2(F.concat_ws(":", F.coalesce(F.col("doc_id").cast("string"), F.lit("")),
                             F.coalesce("text", F.lit(""))).cast("binary"), 256)
    prints = stored(fingerprints(docs.select("doc_id", "text", one.alias("one")), size, "one"), "prints")
    first = F.struct(F.col("doc_id").isNull().alias("missing"), "doc_id", "one")
    kept = (rooted(prints, first, radius).groupBy("root").agg(F.min("first").alias("first"))
            .select("first.one"))
    row = docs.select(one.alias("one"), F.struct(*docs.columns).alias("row"))
    return (row.join(kept, "one").groupBy("one")
            .agg(F.min_by("row", F.xxhash64("row")).alias("row")).select("row.*"))
