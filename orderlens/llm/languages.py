"""Language identification as inference of a mixture.

Training counts character n-grams per language over all training documents. A document is
then a mixture of languages: every word is drawn from one of them, with the probability of
its n-grams there. Expectation-maximisation finds the proportions; the set of languages is
chosen by penalised likelihood (log-likelihood less half a log of the number of words for
each language, as BIC does): languages leave as long as that raises the criterion.

Defined cases: a text that is missing or has no letter is "und" with score 0; without any
training text every text is "und"; equal rows give equal results; long texts are read whole.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orderlens.llm.common import in_arrow, remainder

#: N-grams are counted in this many hashed cells: the model's size is this times the languages.
CELLS = 1 << 16
LETTER = re.compile(r"[^\W\d_]")
# Word characters in bytes: letters (A-Z lower-cased) and everything beyond ASCII.
FOLD = np.array([c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c >= 128 else 32
                 for c in range(256)], dtype=np.uint8)


def grams(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashed byte trigrams of all words (with the gap on either side), the start of each
    word among them, and the number of words per text.
    """
    joined = np.frombuffer(b"  " + b"  ".join(texts) + b"  ", dtype=np.uint8)
    low = FOLD[joined]
    x = low.astype(np.uint32)
    code = (x[:-2] << 16) | (x[1:-1] << 8) | x[2:]
    cell = ((code * np.uint32(0x9E3779B1)) >> np.uint32(16)).astype(np.int64)
    # A trigram belongs to a word if its middle byte does.
    middle = low[1:-1] != 32
    first = middle & (low[:-2] == 32)
    ends = np.cumsum([len(t) + 2 for t in texts])
    words = np.diff(np.concatenate(([0], np.cumsum(first)[np.minimum(ends - 1, len(first) - 1)])))
    starts = np.flatnonzero(first[middle])
    return cell[middle], starts, words


def encoded(column) -> list[bytes]:
    return column.cast(pa.binary()).to_pylist()


def train(docs: DataFrame) -> tuple[list[str], np.ndarray]:
    """Languages and log probabilities (languages x CELLS) from (text, lang) rows. Partial
    counts are added on the executors; the driver gets one row per language and cell.
    """
    def count(batch):
        langs, texts = batch.column("lang").to_pylist(), encoded(batch.column("text"))
        found = {"lang": [], "cell": [], "n": []}
        for lang in sorted(set(langs)):
            cells, _, _ = grams([t for t, of in zip(texts, langs) if of == lang])
            n = np.bincount(cells, minlength=CELLS)
            some = np.flatnonzero(n)
            found["lang"] += [lang] * len(some)
            found["cell"].append(some)
            found["n"].append(n[some])
        return {"lang": found["lang"], "cell": np.concatenate(found["cell"]),
                "n": np.concatenate(found["n"])}

    used = docs.where("lang IS NOT NULL AND text IS NOT NULL").select("text", "lang")
    rows = (in_arrow(used, count, "lang string, cell long, n long", 4096)
            .groupBy("lang", "cell").agg(F.sum("n").alias("n"))).toPandas()
    langs = sorted(rows["lang"].unique())
    counts = np.zeros((len(langs), CELLS))
    for k, lang in enumerate(langs):
        own = rows[rows["lang"] == lang]
        counts[k, own["cell"]] = own["n"]
    logs = np.log((counts + 0.5) / (counts.sum(axis=1, keepdims=True) + 0.5 * CELLS))
    return langs, logs.astype(np.float32)


def proportions(like: np.ndarray, words: np.ndarray, allowed: np.ndarray, rounds: int = 20):
    """EM for all documents at once. like: languages x words, 1 at most; words: how many
    each document has, 1 at least; allowed: languages x documents. Gives the proportions
    and the log-likelihoods.
    """
    starts = np.concatenate(([0], np.cumsum(words)[:-1]))
    theta = allowed / allowed.sum(axis=0)
    for _ in range(rounds):
        joint = [like[k] * np.repeat(theta[k], words) for k in range(len(like))]
        total = sum(joint)
        before, theta = theta, np.stack(
            [np.add.reduceat(j / total, starts) / words for j in joint]).astype(np.float32)
        if np.abs(theta - before).max() < 1e-3:
            break
    total = sum(like[k] * np.repeat(theta[k], words) for k in range(len(like)))
    return theta, np.add.reduceat(np.log(total).astype(np.float64), starts)


def infer(texts: list[bytes], logs: np.ndarray) -> np.ndarray:
    """Proportions (texts x languages) of the chosen language sets; all 0 without words."""
    cells, starts, words = grams(texts)
    out = np.zeros((len(texts), len(logs)))
    if not len(starts):
        return out
    full = np.flatnonzero(words)
    words = words[full]
    like = np.stack([np.add.reduceat(row[cells], starts) for row in logs])
    # Very unlikely languages keep a floor, so that no word has likelihood 0 everywhere.
    like = np.exp(np.maximum(like - like.max(axis=0), np.float32(-60)))
    allowed = np.ones((len(logs), len(full)), dtype=np.float32)
    theta, value = proportions(like, words, allowed)
    penalty = 0.5 * np.log(np.maximum(words, 2))
    active = np.arange(len(full))
    while True:
        # Try without the weakest language; the documents that gain go on.
        inside = allowed[:, active].sum(axis=0) > 1
        if not inside.all():
            like = like[:, np.repeat(inside, words[active])]
            active = active[inside]
        if not len(active):
            break
        weakest = np.where(allowed[:, active] > 0, theta[:, active], np.inf).argmin(axis=0)
        trial = allowed[:, active].copy()
        trial[weakest, np.arange(len(active))] = 0
        less, less_value = proportions(like, words[active], trial)
        better = less_value + penalty[active] >= value[active]
        gain = active[better]
        allowed[:, gain], theta[:, gain] = trial[:, better], less[:, better]
        value[gain] = less_value[better]
        like, active = like[:, np.repeat(better, words[active])], gain
    out[full] = theta.T
    return out


def identify(docs: DataFrame, langs: list[str], logs: np.ndarray) -> DataFrame:
    """doc_id, held_out, lang_pred, score (the language's proportion) and, as languages,
    the chosen set of each text.
    """
    def predict(batch):
        texts = batch.column("text").to_pylist()
        lettered = [bool(t) and LETTER.search(t) is not None for t in texts]
        theta = (infer([t.encode() if ok else b"" for t, ok in zip(texts, lettered)], logs)
                 if langs else np.zeros((len(texts), 1)))
        best, score = theta.argmax(axis=1), theta.max(axis=1)
        known = [ok and s > 0 for ok, s in zip(lettered, score)]
        return {
            "doc_id": batch.column("doc_id"), "held_out": batch.column("held_out"),
            "lang_pred": [langs[b] if ok else "und" for b, ok in zip(best, known)],
            "score": [float(s) if ok else 0.0 for s, ok in zip(score, known)],
            "languages": [",".join(langs[k] for k in np.flatnonzero(t > 0)) if ok else ""
                          for t, ok in zip(theta, known)],
        }

    return in_arrow(
        docs.select("doc_id", "held_out", "text"), predict,
        "doc_id long, held_out boolean, lang_pred string, score double, languages string", 256)


def language_table(docs: DataFrame) -> DataFrame:
    """Learns from three quarters of the documents and predicts all."""
    marked = docs.select("doc_id", "text", "lang",
                         (remainder("doc_id", 4) == 2).alias("held_out"))
    return identify(marked, *train(marked.where("NOT held_out")))
