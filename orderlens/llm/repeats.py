"""Exact repeats of at least ``LENGTH`` bytes, found on Burrows-Wheeler transforms.

A byte goes if a LENGTH-byte string that also starts earlier in the corpus covers it
(smaller doc_id, or same document, earlier start).

One transform of a whole corpus fits no task, so the positions are dealt first, losslessly:
the least hash of all GRAM-byte strings inside a LENGTH-byte window is the window's key,
so equal windows have equal keys. Neighbouring windows with one key form a segment. Only
segments whose key stands more than once (or that may repeat within themselves) go on; equal
segments are one, in the task that cuts them and again where their keys meet.

Where keys meet, the different segments form a text with a suffix order and its transform.
Starting from the whole range, intervals of suffixes are extended backwards breadth first;
the round that finds a new right end of an interval gives the length of the common prefix
there. The rounds stop at LENGTH: ends not found by then separate nothing, so the suffixes
between found ends agree in LENGTH bytes, and all but the first of them are repeats.

Defined cases: a missing or empty text has no bytes and none removed; texts shorter than
LENGTH keep all; a missing doc_id counts as the smallest; rows that agree in doc_id and text
are one document and give equal rows; rows with one doc_id and different texts are different
documents, ordered by the hash of the text; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from orderlens.llm.common import in_arrow, stored, whole_texts

LENGTH = 100
GRAM = 24
#: Bytes of segments that one transform takes; a longer segment is taken alone.
TRANSFORM = 1 << 19
#: Bytes of text hashed at once, and segments a task holds to find equal ones.
HASHED = 1 << 19
HELD = 200_000


# -- windows and their keys -------------------------------------------------------------


def gram_hashes(data: np.ndarray) -> np.ndarray:
    """A hash of the GRAM bytes from each position."""
    h, n, out, done = data.astype(np.uint64) + np.uint64(1), 1, None, 0
    size = GRAM
    while size:
        if size & 1:
            if out is None:
                out = h
            else:
                m = min(len(out), len(h) - done)
                out = out[:m] * np.uint64(0x9E3779B97F4A7C15 + 2 * n) + h[done:done + m]
            done += n
        size >>= 1
        if size:
            h = h[:-n] * np.uint64(0xD6E8FEB86659FD93 + 2 * n) + h[n:]
            n *= 2
    out = (out ^ (out >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return out ^ (out >> np.uint64(32))


def least_in(h: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each ``width`` neighbours."""
    n = 1
    while 2 * n <= width:
        h = np.minimum(h[:-n], h[n:])
        n *= 2
    return np.minimum(h[:len(h) - (width - n)], h[width - n:]) if width > n else h


def segments(texts: list[bytes]):
    """(text number, first window, windows, key, may repeat within itself) of each segment."""
    width = LENGTH - GRAM + 1
    lengths = np.array([len(t) for t in texts], dtype=np.int64)
    data = np.frombuffer(b"".join(texts), dtype=np.uint8)
    if len(data) < LENGTH:
        none = np.empty(0, np.int64)
        return none, none, none, none.astype(np.uint64), none.astype(bool)
    hashes = gram_hashes(data)
    keys = least_in(hashes, width)
    ends = np.cumsum(lengths)
    text = np.repeat(np.arange(len(texts)), lengths)[:len(keys)]
    whole = np.arange(len(keys)) + LENGTH <= ends[text]  # windows that stay in their text
    new = np.ones(len(keys), dtype=bool)
    new[1:] = (keys[1:] != keys[:-1]) | (text[1:] != text[:-1]) | ~whole[:-1]
    first = np.flatnonzero(new & whole)
    stop = np.flatnonzero(np.append(new[1:] | ~whole[1:], True) & whole) + 1
    # Two places of the least hash: a window of the segment may recur within it.
    inside = np.arange(width)
    low = np.empty(len(first), dtype=np.int64)
    high = np.empty(len(first), dtype=np.int64)
    for k in range(0, len(first), 4096):
        some = slice(k, k + 4096)
        low[some] = first[some] + hashes[first[some, None] + inside].argmin(axis=1)
        high[some] = stop[some] - 1 + (width - 1) - hashes[
            (stop[some, None] - 1) + inside[::-1]].argmin(axis=1)
    of = text[first]
    return of, first - (ends - lengths)[of], stop - first, keys[first], low != high


# -- the transform ----------------------------------------------------------------------


def sorting_order(word: np.ndarray, bits: int) -> np.ndarray:
    """Order of ``bits``-bit numbers; where number and place fit 64 bits, they are sorted as one."""
    places = max(int(len(word) - 1).bit_length(), 1)
    if bits + places > 64:
        return np.argsort(word, kind="stable")
    packed = np.sort((word << np.uint64(places)) | np.arange(len(word), dtype=np.uint64))
    return (packed & np.uint64((1 << places) - 1)).astype(np.int64)


def suffix_order(data: np.ndarray) -> np.ndarray:
    """Start positions in the order of at least LENGTH following symbols."""
    n, depth = len(data), 5
    padded = np.concatenate((data, np.zeros(depth, np.uint8))).astype(np.uint64)
    word, bits = np.zeros(n, dtype=np.uint64), 8 * depth
    for k in range(depth):
        word = (word << np.uint64(8)) | padded[k:k + n]
    while True:
        order = sorting_order(word, bits)
        ranked = word[order]
        rank = np.empty(n, dtype=np.uint64)
        rank[order] = np.cumsum(np.concatenate(([0], ranked[1:] != ranked[:-1]))).astype(np.uint64)
        if depth >= LENGTH or int(rank[order[-1]]) == n - 1:
            return order
        half = int(n).bit_length()
        word, bits = rank << np.uint64(half), 2 * half
        word[:-depth] |= rank[depth:] + np.uint64(1)
        depth *= 2


def class_starts(data: np.ndarray, order: np.ndarray, least: int = LENGTH) -> np.ndarray:
    """Marks the ranks where a class of suffixes begins that agree in ``least`` symbols.
    Symbol 0 ends a segment; no interval is extended across it.
    """
    n = len(data)
    bwt = data[order - 1]
    by_symbol = np.argsort(bwt, kind="stable")
    step = np.empty(n, dtype=np.int64)
    step[by_symbol] = np.arange(n)
    found = np.zeros(n + 1, dtype=bool)
    found[0] = found[n] = True
    # First the intervals of single symbols, the end mark's included.
    symbols = np.bincount(data, minlength=256)
    right = np.cumsum(symbols)[symbols > 0]
    left = right - symbols[symbols > 0]
    found[right] = True
    for _ in range(1, least):
        if not len(left):
            break
        size = right - left
        of = np.repeat(np.arange(len(left)), size)
        at = np.arange(len(of)) - np.repeat(np.cumsum(size) - size, size) + left[of]
        symbol = bwt[at]
        real = symbol > 0
        of, symbol, to = of[real], symbol[real].astype(np.int64), step[at[real]]
        if not len(of):
            break
        group = of * 256 + symbol
        if (size > 1).any():
            sort = sorting_order(group.astype(np.uint64), int(group.max()).bit_length())
            group, to = group[sort], to[sort]
        head = np.flatnonzero(np.concatenate(([True], group[1:] != group[:-1])))
        tail = np.append(head[1:], len(group)) - 1
        begin, end = to[head], to[tail] + 1
        fresh = ~found[end]
        found[end] = True
        left, right = begin[fresh], end[fresh]
    return found[:n]


def repeated_windows(parts: list[bytes]) -> list[np.ndarray]:
    """For different segments, in the order of their places: which windows of each stand
    earlier, in an earlier segment or further left in their own.
    """
    lengths = np.array([len(p) for p in parts])
    # Bytes become 1 and up, so that 0 is free as the end mark; the rarest value, 255, is
    # no byte of UTF-8 text.
    data = np.frombuffer(b"\xff".join(parts) + b"\xff", dtype=np.uint8) + np.uint8(1)
    order = suffix_order(data)
    number = np.cumsum(class_starts(data, order)) - 1
    first = np.full(int(number[-1]) + 1, len(data), dtype=np.int64)
    np.minimum.at(first, number, order)
    again = np.empty(len(data), dtype=bool)
    again[order] = first[number] != order
    begin = np.cumsum(lengths + 1) - (lengths + 1)
    return [again[b:b + n - LENGTH + 1] for b, n in zip(begin, lengths)]


# -- Spark ------------------------------------------------------------------------------

KEY = ["did", "h"]


def identified(docs: DataFrame, *more: str | Column) -> DataFrame:
    """did, h (together they tell documents apart and order them) and text."""
    smallest = F.lit(-(1 << 63)).cast("long")
    return whole_texts(docs, *more).withColumn("did", F.coalesce("doc_id", smallest)).withColumn(
        "h", F.xxhash64("text"))


def pieces(texts: list[bytes]):
    """Ranges of texts with about HASHED bytes."""
    start = size = 0
    for k, t in enumerate(texts):
        size += len(t)
        if size >= HASHED:
            yield start, k + 1
            start, size = k + 1, 0
    if start < len(texts):
        yield start, len(texts)


def keyed_segments(docs: DataFrame) -> DataFrame:
    """(key, did, h, start, windows) of the segments that may hold repeats."""
    def mark(batch):
        texts = batch.column("text").cast(pa.binary()).to_pylist()
        did, h = batch.column("did").to_numpy(), batch.column("h").to_numpy()
        for a, b in pieces(texts):
            of, start, windows, key, within = segments(texts[a:b])
            _, first, which, times = np.unique(
                key, return_index=True, return_inverse=True, return_counts=True)
            # Of a key that repeats here one segment tells the others; the rest of them is
            # known to stay and dealt anywhere, so a crowded key is no crowd in one task.
            deal = key ^ (np.arange(len(key), dtype=np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
            deal[first] = key[first]
            yield pa.RecordBatch.from_pydict({
                "deal": deal.view(np.int64), "key": key.view(np.int64),
                "did": did[a:b][of], "h": h[a:b][of], "start": start.astype(np.int32),
                "windows": windows.astype(np.int32), "within": within | (times[which] > 1)})

    def work(batches):
        for batch in batches:
            yield from mark(batch)

    def shared(batches):
        held = None
        for batch in batches:
            if not batch.num_rows:
                continue
            rows = batch if held is None else pa.Table.from_batches([held, batch]).combine_chunks().to_batches()[0]
            key = rows.column("key").to_numpy()
            same = key[1:] == key[:-1]
            keep = rows.column("within").to_numpy(zero_copy_only=False).copy()
            keep[1:] |= same
            keep[:-1] |= same
            # The last row waits for the next batch; one that is known to stay is marked so.
            last = rows.slice(rows.num_rows - 1)
            held = last.set_column(last.schema.get_field_index("within"), "within", pa.array(keep[-1:]))
            yield rows.slice(0, rows.num_rows - 1).filter(pa.array(keep[:-1]))
        if held is not None:
            yield held.filter(held.column("within"))

    schema = "deal long, key long, did long, h long, start int, windows int, within boolean"
    return (docs.select(*KEY, "text").mapInArrow(work, schema)
            .repartition("deal").sortWithinPartitions("deal")
            .mapInArrow(shared, schema).drop("deal", "within"))


PLACED = "kind int, key long, part binary, did long, h long, start int, stop int"


class Firsts:
    """Equal segments held as one: the first place stays, every other one is a repeat."""

    def __init__(self):
        self.held, self.out = {}, []

    def add(self, key: int, part: bytes, place: tuple[int, int, int]) -> None:
        before = self.held.setdefault((key, part), place)
        if place < before:
            self.held[key, part], place = place, before
            before = self.held[key, part]
        if place != before:
            self.out.append((*place, place[2] + len(part)))


def cut_segments(docs: DataFrame, marked: DataFrame) -> DataFrame:
    """The bytes of marked segments. kind 0: a first place, to be compared under its key;
    kind 1: a repeat of an equal segment that the same task holds.
    """
    def rows(firsts: Firsts):
        places = list(firsts.held.items())
        n, m = len(places), len(firsts.out)
        yield pa.RecordBatch.from_pydict({
            "kind": pa.array([0] * n + [1] * m, pa.int32()),
            "key": pa.array([k for (k, _), _ in places] + [0] * m, pa.int64()),
            "part": pa.array([p for (_, p), _ in places] + [None] * m, pa.binary()),
            **{c: pa.array([x[j] for _, x in places] + [x[j] for x in firsts.out],
                           pa.int64() if j < 2 else pa.int32())
               for j, c in enumerate(("did", "h", "start"))},
            "stop": pa.array([0] * n + [x[3] for x in firsts.out], pa.int32())})

    def work(batches):
        firsts = Firsts()
        for batch in batches:
            for did, h, text, marks in zip(*(batch.column(c) for c in ("did", "h", "text", "marks"))):
                did, h, data = did.as_py(), h.as_py(), text.as_py().encode()
                flat = marks.values.flatten()
                for key, start, windows in zip(*(x.to_pylist() for x in flat)):
                    firsts.add(key, data[start:start + windows + LENGTH - 1], (did, h, start))
                if len(firsts.held) >= HELD:
                    yield from rows(firsts)
                    firsts = Firsts()
        yield from rows(firsts)

    marks = marked.groupBy(*KEY).agg(F.collect_list(F.struct("key", "start", "windows")).alias("marks"))
    return docs.select(*KEY, "text").join(marks, KEY).mapInArrow(work, PLACED)


def compared(first_places: DataFrame) -> DataFrame:
    """(did, h, start, stop): repeats among the segments of each key."""
    def work(batches):
        firsts, last, size = Firsts(), None, 0
        for batch in batches:
            columns = [batch.column(c).to_pylist() for c in ("key", "part", "did", "h", "start")]
            for key, part, *place in zip(*columns):
                if key != last and size > TRANSFORM:
                    yield from spans(firsts)
                    firsts, size = Firsts(), 0
                firsts.add(key, part, tuple(place))
                size, last = size + len(part), key
        yield from spans(firsts)

    def spans(firsts: Firsts):
        found = firsts.out
        alone = {}
        for key, _ in firsts.held:
            alone[key] = key not in alone
        width = LENGTH - GRAM + 1
        # A key's only segment can repeat nothing but itself, and only if it is marked so.
        rest = sorted((place, part) for (key, part), place in firsts.held.items()
                      if not alone[key] or recurs(part, width))
        if rest:
            for (did, h, start), again in zip([p for p, _ in rest], repeated_windows([p for _, p in rest])):
                edge = np.flatnonzero(np.diff(np.concatenate(([0], again.view(np.int8), [0]))))
                found += [(did, h, start + int(a), start + int(b) + LENGTH - 1)
                          for a, b in zip(edge[::2], edge[1::2])]
        if found:
            did, h, start, stop = zip(*found)
            yield pa.RecordBatch.from_pydict({
                "did": pa.array(did, pa.int64()), "h": pa.array(h, pa.int64()),
                "start": pa.array(start, pa.int32()), "stop": pa.array(stop, pa.int32())})

    return (first_places.select("key", "part", *KEY, "start").repartition("key")
            .sortWithinPartitions("key").mapInArrow(work, "did long, h long, start int, stop int"))


def recurs(part: bytes, width: int) -> bool:
    """Whether a window of the segment may stand in it twice: its GRAM-byte strings do."""
    if len(part) > LENGTH + width:
        return True
    return len({part[k:k + GRAM] for k in range(len(part) - GRAM + 1)}) < len(part) - GRAM + 1


def repeated_spans(docs: DataFrame) -> DataFrame:
    """(did, h, spans): the byte ranges that repeat earlier text; documents without are left out.
    docs: did, h, text.
    """
    marked = stored(keyed_segments(docs), "marked")
    placed = stored(cut_segments(docs, marked), "placed")
    found = compared(placed.where("kind = 0")).unionAll(
        placed.where("kind = 1").select(*KEY, "start", "stop"))
    return found.groupBy(*KEY).agg(F.collect_set(F.struct("start", "stop")).alias("spans"))


def merged(spans) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for span in sorted((s["start"], s["stop"]) for s in (() if spans is None else spans)):
        if out and span[0] <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], span[1]))
        else:
            out.append(span)
    return out


def kept_bytes(data: bytes, spans: list[tuple[int, int]]) -> bytes:
    at, parts = 0, []
    for start, stop in spans:
        parts.append(data[at:start])
        at = stop
    return b"".join([*parts, data[at:]])


def repeats_table(docs: DataFrame) -> DataFrame:
    """One row per document: n_bytes, n_removed, n_spans, kept_sha256."""
    def digest(batch):
        out = {c: [] for c in ("n_bytes", "n_removed", "n_spans", "kept_sha256")}
        for text, spans in zip(batch.column("text").to_pylist(), batch.column("spans").to_pylist()):
            data, spans = text.encode(), merged(spans)
            out["n_bytes"].append(len(data))
            out["n_removed"].append(sum(b - a for a, b in spans))
            out["n_spans"].append(len(spans))
            out["kept_sha256"].append(hashlib.sha256(kept_bytes(data, spans)).hexdigest())
        return {"doc_id": batch.column("doc_id"), **out}

    texts = identified(docs)
    found = stored(repeated_spans(texts), "spans")
    return in_arrow(
        texts.join(found, KEY, "left").select("doc_id", "text", "spans"), digest,
        "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


def without_repeats(docs: DataFrame) -> DataFrame:
    """The documents with repeats cut from their texts, all columns kept (n_chars, where there
    is one, follows). Characters that a span holds in part stay whole.
    """
    @F.pandas_udf("string")
    def cut(texts, spans):
        def one(text, found):
            if found is None or not len(found):
                return text
            data = text.encode()
            inner = []
            for start, stop in merged(found):
                while start < stop and data[start] & 0xC0 == 0x80:
                    start += 1
                while stop > start and stop < len(data) and data[stop] & 0xC0 == 0x80:
                    stop -= 1
                inner.append((start, stop))
            return kept_bytes(data, inner).decode()
        return texts.combine(spans, one)

    rows = identified(docs.select("doc_id", "text", F.struct(*docs.columns).alias("row")), "row")
    found = stored(repeated_spans(rows.select(*KEY, "text")), "spans")
    # Only texts with spans change; a missing text stays missing.
    out = rows.join(found, KEY, "left").withColumn("cut", F.when(
        F.col("spans").isNotNull(), cut("text", "spans")).otherwise(F.col("row.text")))
    changed = {"text": F.col("cut")}
    if "n_chars" in docs.columns:
        changed["n_chars"] = F.when(F.col("spans").isNull(), F.col("row.n_chars")).otherwise(
            F.char_length("cut")).cast(dict(docs.dtypes)["n_chars"])
    return out.select(*[changed.get(c, F.col("row")[c]).alias(c) for c in docs.columns])
