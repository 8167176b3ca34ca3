"""A hidden Markov language model over words.

Latent states emit word classes: each of the commonest words is a class of its own, all
others share classes by their last letters. Given its class a word has probability
(c + 1) / (S + n + 1), with c its count, S and n the tokens and distinct words of its class
in training; the 1 over is left for words never seen. The number of classes grows with the
square root of the vocabulary, from CLASSES on, and word counts cover all of it.

Baum-Welch runs over every training text: each task adds up the expected transitions and
emissions of its texts, the sums are added across tasks, and the driver turns them into the
next model. The likelihood of a text is exact: the forward recursion, scaled at each token,
with long texts cut into blocks whose transfer matrices are multiplied up.

Word counts meet the texts in two ways: at most HEAD of the commonest words of at most
HEAD_BYTES bytes each travel as a table, all others are joined by word in a shuffle. The
end's count is fetched on its own, so no result depends on which words travel, but for which
of them are classes of their own.

Defined cases: a missing or empty text is the end token alone; without training texts every
word is unknown and the classes are uniform; equal rows get equal scores (they are counted
as often as they stand); a missing doc_id has remainder 0 and is training text.
"""

from __future__ import annotations

import math
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orderlens.llm.common import in_arrow, remainder, stored, whole_texts

#: Word lookup travels to the tasks for this many of the commonest words.
HEAD = 1 << 18
HEAD_BYTES = 64
#: Cells of a band of counts that does not travel whole.
CELLS = 1024
STATES = 4
#: Fewest classes: the end token and the commonest words have one half, cells of last
#: letters the other.
CLASSES = 4096
ROUNDS = 6
#: Tokens per block of the recursion, and per batch of texts.
BLOCK = 256
#: Steps after which the recursion is scaled; the least emissions stay far from underflow.
SCALED = 4
TOKENS = 400_000
#: The end of a text as a token; no word is empty.
END = b""


def tokens(text: bytes) -> list[bytes]:
    return text.lower().split()


def classes_for(distinct: int) -> int:
    """The least power of two that is at least 4 * sqrt(distinct words), CLASSES or more."""
    return max(CLASSES, 1 << math.ceil(math.log2(4 * math.sqrt(max(distinct, 1)))))


def class_type(classes: int) -> str:
    """Stored classes take two bytes a token while they fit."""
    return "<u2" if classes <= 1 << 16 else "<u4"


def word_counts(docs: DataFrame) -> DataFrame:
    """(word, c) over (text) rows, the end token among them."""
    def work(batches):
        seen = Counter()
        for batch in batches:
            for text in batch.column(0).cast(pa.binary()):
                seen.update(tokens(text.as_py()))
                seen[END] += 1
                if len(seen) > 400_000:
                    yield counted(seen)
                    seen = Counter()
        yield counted(seen)

    def counted(seen):
        return pa.RecordBatch.from_pydict({
            "word": pa.array(list(seen), pa.binary()), "c": pa.array(list(seen.values()), pa.int64())})

    return (docs.select("text").mapInArrow(work, "word binary, c long")
            .groupBy("word").agg(F.sum("c").alias("c")))


def commonest(counts: DataFrame, most: int) -> list[tuple[bytes, int]]:
    """At most ``most`` of the commonest words of up to HEAD_BYTES bytes, commonest first,
    without the end. Words are counted per band of counts (about a thousand bands) and the
    bands that fit are fetched whole; of the first one that does not fit, the words in the
    lowest cells of their digest. So no task sends more than its share of them.
    """
    counts = counts.where("octet_length(word) BETWEEN 1 AND " + str(HEAD_BYTES))
    band = F.floor(F.log2("c") * 16).cast("int")
    bands = {r.band: r.n for r in counts.groupBy(band.alias("band")).agg(
        F.count("*").alias("n")).collect()}
    wanted, left = F.lit(False), most
    for b in sorted(bands, reverse=True):
        if bands[b] > left:
            cell = F.pmod(F.xxhash64("word"), F.lit(CELLS))
            cells = {r.cell: r.n for r in counts.where(band == b).groupBy(cell.alias("cell")).agg(
                F.count("*").alias("n")).collect()}
            below = 0
            while below < CELLS and cells.get(below, 0) <= left:
                left -= cells.get(below, 0)
                below += 1
            wanted = (band > b) | ((band == b) & (cell < below))
            break
        left -= bands[b]
        wanted = band >= b
    rows = counts.where(wanted).collect()
    return sorted(((bytes(r.word), r.c) for r in rows), key=lambda x: (-x[1], x[0]))


class Words:
    """Class, log10(c + 1) and c > 0 of the commonest words and the end, which stands ``end``
    times; others get their class by rule."""

    def __init__(self, head: list[tuple[bytes, int]], end: int = 0, classes: int = CLASSES):
        self.classes, self.own = classes, classes // 2 - 1
        common = [w for w, _ in head if w != END][:self.own]
        self.common = {w: k + 1 for k, w in enumerate(common)} | {END: 0}
        self.known = {w: (self.class_of(w), math.log10(c + 1), 1) for w, c in head}
        self.known[END] = (0, math.log10(end + 1), int(end > 0))

    def tail_class(self, word: bytes) -> int:
        return self.own + 1 + zlib.crc32(word[-3:]) % (self.classes - self.own - 1)

    def class_of(self, word: bytes) -> int:
        found = self.common.get(word)
        return self.tail_class(word) if found is None else found


# -- the recursion -------------------------------------------------------------------


class Blocks:
    """Observations of some texts cut into blocks, longest blocks first, so that the blocks
    that have a t-th token are the first ``alive[t]``.
    """

    def __init__(self, obs: np.ndarray, lengths: np.ndarray):
        per = -(-lengths // BLOCK)
        text = np.repeat(np.arange(len(lengths)), per)
        first = np.cumsum(per) - per
        place = np.arange(len(text)) - first[text]
        begin = (np.cumsum(lengths) - lengths)[text] + place * BLOCK
        size = np.minimum(BLOCK, lengths[text] - place * BLOCK)
        order = np.argsort(-size, kind="stable")
        self.obs, self.per, self.first = obs, per, first
        self.begin, self.size = begin[order], size[order]
        self.row = np.empty(len(order), dtype=np.int64)  # of each block in text order
        self.row[order] = np.arange(len(order))
        self.text = text[order]
        steps = int(size.max(initial=0))
        self.alive = np.searchsorted(-self.size, -np.arange(steps), side="left")
        # Transfer matrices are needed where another block follows.
        self.moves = (place < per[text] - 1)[order]

    def at(self, t: int) -> np.ndarray:
        return self.obs[self.begin[:self.alive[t]] + t]

    def transfers(self, a: np.ndarray, b: np.ndarray):
        """Of each block that is followed: the product of emission and transition, scaled."""
        k = len(a)
        which = np.flatnonzero(self.moves)
        place = np.full(len(self.begin), -1)
        place[which] = np.arange(len(which))
        m = np.broadcast_to(np.eye(k), (len(which), k, k)).copy()
        # A block that is followed is full.
        for t in range(BLOCK if len(which) else 0):
            m *= b.T[self.obs[self.begin[which] + t]][:, None, :]
            m = (m.reshape(-1, k) @ a).reshape(-1, k, k)
            if t % SCALED == SCALED - 1 or t == BLOCK - 1:
                m /= m.sum(axis=(1, 2), keepdims=True)
        return place, m

    def starts(self, start: np.ndarray, place: np.ndarray, m: np.ndarray) -> np.ndarray:
        """State distribution before each block's first token (states x blocks)."""
        pred = np.empty((len(self.begin), len(start)))
        now = np.broadcast_to(start, (len(self.per), len(start))).copy()
        for j in range(int(self.per.max(initial=0))):
            texts = np.flatnonzero(self.per > j)
            rows = self.row[self.first[texts] + j]
            pred[rows] = now[texts]
            go = self.per[texts] > j + 1
            texts, rows = texts[go], rows[go]
            now[texts] = np.einsum("ni,nij->nj", now[texts], m[place[rows]])
            now[texts] /= now[texts].sum(axis=1, keepdims=True)
        return pred.T.copy()

    def ends(self, place: np.ndarray, m: np.ndarray, head: np.ndarray) -> np.ndarray:
        """What follows each block, seen from the state after its last token (states x blocks).
        head: of each text's last block, its likelihood from every state before it.
        """
        after = np.ones((len(self.begin), len(head)))
        head = head.T
        for j in range(int(self.per.max(initial=0)) - 2, -1, -1):
            texts = np.flatnonzero(self.per > j + 1)
            rows, following = self.row[self.first[texts] + j], self.row[self.first[texts] + j + 1]
            last = place[following] < 0
            after[rows[last]] = head[following[last]]
            rows, following = rows[~last], following[~last]
            after[rows] = np.einsum("nij,nj->ni", m[place[following]], after[following])
            after[rows] /= after[rows].sum(axis=1, keepdims=True)
        return after.T.copy()

    def forward(self, pred: np.ndarray, a: np.ndarray, b: np.ndarray, keep: bool):
        """Log-likelihood of each block, and the scaled state weights before each token."""
        logs, now, kept = np.zeros(len(self.begin)), pred.copy(), []
        for t, n in enumerate(self.alive):
            if keep:
                kept.append(now[:, :n].copy())
            after = a.T @ (now[:, :n] * np.take(b, self.at(t), axis=1))
            if t % SCALED == SCALED - 1:
                scale = after.sum(axis=0)
                logs[:n] += np.log(scale)
                after /= scale
            now[:, :n] = after
        return logs + np.log(now.sum(axis=0)), kept

    def heads(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Of the last block of each longer text: its likelihood from every state before it."""
        which = np.flatnonzero(~self.moves & (self.per[self.text] > 1))
        size, begin = self.size[which], self.begin[which]
        after = np.ones((len(a), len(which)))
        for t in range(int(size.max(initial=0)) - 1, -1, -1):
            n = int(np.searchsorted(-size, -t, side="left"))
            back = np.take(b, self.obs[begin[:n] + t], axis=1) * (a @ after[:, :n])
            after[:, :n] = back / back.sum(axis=0) if t % SCALED == 0 else back
        head = np.ones((len(a), len(self.begin)))
        head[:, which] = after
        return head


def log_likelihoods(obs: np.ndarray, lengths: np.ndarray, model) -> np.ndarray:
    start, a, b = model
    blocks = Blocks(obs, lengths)
    place, m = blocks.transfers(a, b)
    logs, _ = blocks.forward(blocks.starts(start, place, m), a, b, keep=False)
    return np.bincount(blocks.text, logs, len(lengths))


def expected(obs: np.ndarray, lengths: np.ndarray, model):
    """Expected first states, transitions and emissions of some texts, and their log-likelihood."""
    start, a, b = model
    k = len(a)
    blocks = Blocks(obs, lengths)
    place, m = blocks.transfers(a, b)
    logs, kept = blocks.forward(blocks.starts(start, place, m), a, b, keep=True)
    after = blocks.ends(place, m, blocks.heads(a, b))
    firsts, moves, emits = np.zeros(k), np.zeros((k, k)), np.zeros((k, b.shape[1]))
    begins = np.zeros(len(blocks.begin), dtype=bool)
    begins[blocks.row[blocks.first]] = True
    final = np.zeros(len(blocks.begin), dtype=bool)
    final[blocks.row[blocks.first + blocks.per - 1]] = True
    seen, weights = [], []
    for t in range(len(blocks.alive) - 1, -1, -1):
        n = blocks.alive[t]
        word = blocks.at(t)
        emission = np.take(b, word, axis=1)
        joint, behind = kept[t] * emission, after[:, :n]
        beyond = a @ behind
        gamma = joint * beyond
        total = gamma.sum(axis=0)
        gamma /= total
        # No transition follows a text's last token.
        joint /= np.where(final[:n] & (blocks.size[:n] == t + 1), np.inf, total)
        moves += a * (joint @ behind.T)
        seen.append(word)
        weights.append(gamma)
        if t == 0:
            firsts += gamma[:, begins].sum(axis=1)
        back = emission * beyond
        after[:, :n] = back / back.sum(axis=0) if t % SCALED == 0 else back
    word, gamma = np.concatenate(seen), np.concatenate(weights, axis=1)
    for i in range(k):
        emits[i] = np.bincount(word, gamma[i], b.shape[1])
    return firsts, moves, emits, logs.sum()


# -- training and scoring on Spark ------------------------------------------------------


def batches_of(batches, column: str, kind: str):
    """Groups of rows with at most TOKENS tokens together (or one text)."""
    for batch in batches:
        sizes = [len(x) // np.dtype(kind).itemsize for x in batch.column(column).to_pylist()]
        start = held = 0
        for k, size in enumerate(sizes):
            if held and held + size > TOKENS:
                yield batch.slice(start, k - start)
                start, held = k, 0
            held += size
        if start < batch.num_rows:
            yield batch.slice(start)


def observations(batch, kind: str, column: str = "classes") -> tuple[np.ndarray, np.ndarray]:
    texts = [np.frombuffer(x, kind) for x in batch.column(column).to_pylist()]
    return np.concatenate(texts).astype(np.int64), np.array([len(x) for x in texts])


def first_model(class_counts: np.ndarray, states: int):
    """Sticky states whose emissions differ a little from the corpus, always the same way."""
    rng = np.random.default_rng(7)
    base = (class_counts + 1) / (class_counts.sum() + len(class_counts))
    b = base * np.exp(rng.normal(0, 1.0, (states, len(base))))
    a = np.full((states, states), 0.02 / max(states - 1, 1)) + np.eye(states) * 0.98
    return (np.full(states, 1 / states), a / a.sum(axis=1, keepdims=True),
            b / b.sum(axis=1, keepdims=True))


def baum_welch(texts: DataFrame, class_counts: np.ndarray, states: int = STATES,
               rounds: int = ROUNDS):
    """texts: rows with ``classes``. Each round reads all of them; the sums that reach the
    driver are states * (1 + states + classes) numbers.
    """
    model = first_model(class_counts, states)
    base = (class_counts + 1) / (class_counts.sum() + len(class_counts))
    size = states * (1 + states + len(class_counts))
    kind = class_type(len(class_counts))
    for _ in range(rounds):
        now = model

        def work(batches, now=now):
            sums = np.zeros(size)
            for batch in batches_of(batches, "classes", kind):
                firsts, moves, emits, _ = expected(*observations(batch, kind), now)
                sums += np.concatenate((firsts, moves.ravel(), emits.ravel()))
            met = np.flatnonzero(sums)
            yield pa.RecordBatch.from_pydict({"at": met.astype(np.int32), "x": sums[met]})

        rows = (texts.select("classes").mapInArrow(work, "at int, x double")
                .groupBy("at").agg(F.sum("x").alias("x")).toPandas())
        sums = np.zeros(size)
        sums[rows["at"]] = rows["x"]
        firsts, moves = sums[:states] + 0.1, sums[states:states * (1 + states)].reshape(states, -1) + 0.1
        emits = sums[states * (1 + states):].reshape(states, -1) + base * 10
        model = (firsts / firsts.sum(), moves / moves.sum(axis=1, keepdims=True),
                 emits / emits.sum(axis=1, keepdims=True))
    return model


def score_texts(docs: DataFrame, states: int = STATES, rounds: int = ROUNDS) -> DataFrame:
    """docs: doc_id, text, held_out. Learns from the rows that are not held out and scores
    all: n_tokens, n_known, train_tokens, base_score, score.
    """
    spark = docs.sparkSession
    counts = stored(word_counts(docs.where("NOT held_out")), "words")
    facts = counts.agg(F.sum("c").alias("n"), F.count("*").alias("v"),
                       F.max(F.when(F.octet_length("word") == 0, F.col("c"))).alias("ends")).first()
    n_all, distinct = facts.n or 0, facts.v or 0
    classes = classes_for(distinct)
    kind = class_type(classes)
    words = Words(commonest(counts, HEAD), facts.ends or 0, classes)
    shared = spark.sparkContext.broadcast(words)

    def classify(batch):
        return {"word": batch.column(0), "c": batch.column(1),
                "class": [shared.value.class_of(w) for w in batch.column(0).to_pylist()]}

    by_class = (in_arrow(counts, classify, "word binary, c long, class int", 4096)
                .groupBy("class").agg(F.sum("c").alias("s"), F.count("*").alias("n")).collect())
    tokens_in, words_in = np.zeros(classes), np.zeros(classes)
    for r in by_class:
        tokens_in[r["class"]], words_in[r["class"]] = r.s, r.n
    class_logs = np.log10(tokens_in + words_in + 1)

    def read(batch):
        """Classes of the tokens; the sums over the commonest words; the other words."""
        known, tail_class = shared.value.known, shared.value.tail_class
        out = {name: [] for name in ("n_tokens", "n_known", "log_counts", "class_logs", "classes", "rare", "times")}
        for text in batch.column(1).cast(pa.binary()).to_pylist():
            line = tokens(text)
            line.append(END)
            at, rare, n_known, logs = {}, {}, 0, 0.0
            for w, times in Counter(line).items():
                hit = known.get(w)
                if hit is None:
                    rare[w], at[w] = times, tail_class(w)
                else:
                    at[w] = hit[0]
                    logs += times * hit[1]
                    n_known += times * hit[2]
            # One class for each token, in the order of the text.
            line = np.array([at[w] for w in line], dtype=kind)
            out["n_tokens"].append(len(line))
            out["n_known"].append(n_known)
            out["log_counts"].append(logs)
            out["class_logs"].append(float(class_logs[line].sum()))
            out["classes"].append(line.tobytes())
            out["rare"].append(list(rare))
            out["times"].append(list(rare.values()))
        return {"doc_id": batch.column(0), "held_out": batch.column(2), **out}

    lines = stored(
        in_arrow(docs.select("doc_id", "text", "held_out"), read,
                 "doc_id long, held_out boolean, n_tokens long, n_known long, log_counts double, "
                 "class_logs double, classes binary, rare array<binary>, times array<int>", 256)
        .withColumn("row", F.monotonically_increasing_id()), "lines")
    model = baum_welch(lines.where("NOT held_out"), tokens_in, states, rounds)

    rare = (lines.select("row", F.explode(F.arrays_zip("rare", "times")).alias("one"))
            .select("row", F.col("one.rare").alias("word"), F.col("one.times").alias("times"))
            .join(counts, "word")
            .groupBy("row").agg(F.sum(F.col("times") * F.log10(F.col("c") + 1)).alias("rare_logs"),
                                F.sum("times").alias("rare_known")))

    def likelihood(batches):
        for batch in batches_of(batches, "classes", kind):
            logs = log_likelihoods(*observations(batch, kind), model) / np.log(10)
            yield pa.RecordBatch.from_pydict({
                **{c: batch.column(c) for c in ("row", "doc_id", "held_out", "n_tokens", "n_known",
                                                "log_counts", "class_logs")}, "path": logs})

    scored = lines.select("row", "doc_id", "held_out", "n_tokens", "n_known", "log_counts",
                          "class_logs", "classes").mapInArrow(
        likelihood, "row long, doc_id long, held_out boolean, n_tokens long, n_known long, "
        "log_counts double, class_logs double, path double")
    logs = F.col("log_counts") + F.coalesce("rare_logs", F.lit(0.0))
    return scored.join(rare, "row", "left").select(
        "doc_id", "held_out", "n_tokens",
        (F.col("n_known") + F.coalesce("rare_known", F.lit(0))).alias("n_known"),
        F.lit(n_all).cast("long").alias("train_tokens"),
        (logs - F.col("n_tokens") * F.lit(float(np.log10(n_all + distinct + 1)))).alias("base_score"),
        (logs - F.col("class_logs") + F.col("path")).alias("score"))


def score_table(docs: DataFrame) -> DataFrame:
    """Learns from the documents whose remainder by 7 is not 2, scores all."""
    return score_texts(whole_texts(docs).withColumn("held_out", remainder("doc_id", 7) == 2))
