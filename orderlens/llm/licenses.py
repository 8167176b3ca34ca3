"""License scans with a positional index of rare words.

Templates are phrases and notices with the phrases they must contain. Each template's rarest
words (highest inverse document frequency over the whole corpus), and the rarest of its first
mandatory phrase, are looked up in the templates' postings; a word at file position p and
template position t votes for the template starting at p - t, alignments with two votes are
candidates, and a candidate counts if its mandatory phrases stand word for word near where the
template has them and enough of its words are there. What else a file holds takes no
template's votes away.

For a phrase that is a template on its own, every place is found: each occurrence of its
rarest word proposes an alignment, and the whole phrase is verified there.

Defined cases: a missing or empty text has no words and no labels; equal rows give equal
results; texts of any length are read whole, a batch at a time.
"""

from __future__ import annotations

import math
from collections import Counter, defaultdict
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orderlens.llm.common import in_arrow, whole_texts

# Phrases whose places are counted, with their labels.
PHRASES = {
    "under the mit license": "mit",
    "apache license version 2": "apache-2",
    "cc by nc": "cc-by-nc",
}

# Opening words of public license notices, their labels, and the phrases a
# text must contain to carry the label.
NOTICES = [
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this "
     "software and associated documentation files",
     ["permission is hereby granted free of charge", "associated documentation files"]),
    ("apache-2", "licensed under the apache license version 2 0 the license you may not use this "
     "file except in compliance with the license",
     ["apache license version 2 0", "except in compliance with the license"]),
    ("bsd", "redistribution and use in source and binary forms with or without modification are "
     "permitted provided that the following conditions are met",
     ["redistribution and use in source and binary forms", "following conditions are met"]),
    ("gpl", "this program is free software you can redistribute it and or modify it under the "
     "terms of the gnu general public license as published by the free software foundation",
     ["gnu general public license", "free software foundation"]),
    ("mpl-2", "this source code form is subject to the terms of the mozilla public license v 2 0",
     ["subject to the terms of the mozilla public license"]),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with "
     "or without fee is hereby granted",
     ["copy modify and or distribute this software", "without fee is hereby granted"]),
    ("cc-by-nc", "this work is licensed under a creative commons attribution noncommercial "
     "international license", ["creative commons attribution noncommercial"]),
    ("cc-by", "this work is licensed under a creative commons attribution 4 0 international license",
     ["creative commons attribution 4 0 international license"]),
    ("unlicense", "this is free and unencumbered software released into the public domain",
     ["free and unencumbered software released into the public domain"]),
]

# Words consist of a-z, 0-9 and everything beyond ASCII; A-Z is lower-cased first.
SPLIT = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128
              else 32 for c in range(256))


def words_of(text: str) -> list[bytes]:
    return text.encode().translate(SPLIT).split()


@dataclass(frozen=True)
class Template:
    label: str
    words: tuple[bytes, ...]
    #: (position in the template, words) of what must stand in the file.
    mandatory: tuple[tuple[int, tuple[bytes, ...]], ...]
    base: bool


def find(words: tuple[bytes, ...], part: tuple[bytes, ...]) -> int:
    return next(i for i in range(len(words)) if words[i:i + len(part)] == part)


def templates(phrases: dict[str, str] = PHRASES, notices=NOTICES) -> list[Template]:
    out = []
    for phrase, label in phrases.items():
        words = tuple(words_of(phrase))
        out.append(Template(label, words, ((0, words),), True))
    for label, text, keys in notices:
        words = tuple(words_of(text))
        parts = [tuple(words_of(key)) for key in keys]
        out.append(Template(label, words, tuple((find(words, p), p) for p in parts), False))
    return out


def document_frequencies(docs: DataFrame, vocabulary: frozenset[bytes]) -> tuple[int, dict]:
    """Number of documents, and of documents with each template word: one sum over all
    documents, at most as many numbers as the templates have words.
    """
    def count(batch):
        seen = Counter({b"": batch.num_rows})
        for text in batch.column(0).to_pylist():
            seen.update(vocabulary.intersection(words_of(text)))
        return {"word": list(seen), "n": list(seen.values())}

    counted = (in_arrow(docs.select("text"), count, "word binary, n long", 4096)
               .groupBy("word").agg(F.sum("n").alias("n")).collect())
    found = {bytes(r["word"]): r["n"] for r in counted}
    return found.pop(b"", 0), found


class Index:
    """Postings of the templates' words, rarest words first."""

    def __init__(self, known: list[Template], n_docs: int, frequency: dict[bytes, int],
                 rare: int = 8, least: float = 0.6, slack: int = 3):
        self.known, self.least, self.slack = known, least, slack
        every = {w for t in known for w in t.words}
        self.idf = {w: math.log((n_docs + 1) / (frequency.get(w, 0) + 1)) for w in every}
        self.order = {w: i for i, w in enumerate(sorted(every, key=lambda w: (-self.idf[w], w)))}
        # The rarest words of each template: all a scan has to look up first. Two of a notice's
        # are in its first mandatory phrase, so that wherever this stands it gets two votes.
        self.keys = {k: self.rarest(t.words, 1 if t.base else rare) for k, t in enumerate(known)}
        for k, t in enumerate(known):
            if not t.base:
                self.keys[k] |= self.rarest(t.mandatory[0][1], 2)
        self.lookup = frozenset().union(*self.keys.values())
        self.postings = defaultdict(list)
        for k, t in enumerate(known):
            for i, w in enumerate(t.words):
                if w in self.keys[k]:
                    self.postings[w].append((k, i))

    def rarest(self, words: tuple[bytes, ...], n: int) -> set[bytes]:
        return set(sorted(set(words), key=self.order.get)[:n])

    def stands(self, words: list[bytes], at: int, part: tuple[bytes, ...]) -> bool:
        return at >= 0 and tuple(words[at:at + len(part)]) == part

    def near(self, words: list[bytes], at: int, part: tuple[bytes, ...]) -> bool:
        """Near its place: a few words may have been put in or left out before it."""
        return any(self.stands(words, at + s, part) for s in range(-self.slack, self.slack + 1))

    def scan(self, words: list[bytes]):
        """Places of phrases (template, start) and labelled alignments (template, start, share)."""
        present = self.lookup.intersection(words)
        if not present:
            return [], []
        votes, places = Counter(), []
        for p, w in enumerate(words):
            if w in present:
                for k, t in self.postings[w]:
                    votes[k, p - t] += 1
        found = []
        for (k, start), n in votes.items():
            t = self.known[k]
            if t.base:
                if self.stands(words, start, t.words):
                    places.append((k, start))
                continue
            # Words put in or left out shift later words: neighbours vote together.
            near = sum(votes.get((k, start + s), 0) for s in range(-self.slack, self.slack + 1))
            if near >= min(2, len(set(t.mandatory[0][1]))) and all(
                    self.near(words, start + at, part) for at, part in t.mandatory):
                share = sum(any(self.stands(words, start + i + s, (w,))
                                for s in range(-self.slack, self.slack + 1))
                            for i, w in enumerate(t.words)) / len(t.words)
                if share >= self.least:
                    found.append((k, start, share))
        return places, found


SCHEMA = ("doc_id long, n_words long, n_base long, first_word long, last_word long, "
          "base_labels string, labels string, score double")


def scan_licenses(docs: DataFrame, known: list[Template] | None = None, rare: int = 8) -> DataFrame:
    """One row per document: counted phrase places, labels, and how completely the best
    label's words were found (1 where a phrase stands, 0 without a label).
    """
    known = known or templates()
    texts = whole_texts(docs)
    vocabulary = frozenset(w for t in known for w in t.words)
    index = Index(known, *document_frequencies(texts, vocabulary), rare=rare)

    def scan(batch):
        out = {name.split()[0]: [] for name in SCHEMA.split(", ")}
        out["doc_id"] = batch.column(0)
        for text in batch.column(1).to_pylist():
            words = words_of(text)
            places, found = index.scan(words)
            starts = [p for _, p in places]
            base = {known[k].label for k, _ in places}
            out["n_words"].append(len(words))
            out["n_base"].append(len(places))
            out["first_word"].append(min(starts, default=None))
            out["last_word"].append(max(starts, default=None))
            out["base_labels"].append(",".join(sorted(base)))
            out["labels"].append(",".join(sorted(base | {known[k].label for k, *_ in found})))
            out["score"].append(1.0 if base else float(max((s for *_, s in found), default=0.0)))
        return out

    return in_arrow(texts, scan, SCHEMA)
