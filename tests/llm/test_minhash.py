"""SuperMinHash near-duplicates beside brute force over full shingle sets."""

import random
from collections import defaultdict
from itertools import combinations

import numpy as np
import pytest

from orderlens.llm import minhash
from tests.llm.conftest import prose


def shingles(text, size=5):
    words = (text or "").encode().lower().split()
    if not words:
        return frozenset()
    return frozenset(tuple(words[k:k + size]) for k in range(max(1, len(words) - size + 1)))


def brute(rows, percent=85):
    """doc_id -> (set size, component) from all pairs."""
    sets = {doc: shingles(text) for doc, text, *_ in rows}
    root = {doc: doc for doc in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in combinations(sorted(sets), 2):
        both = len(sets[a] & sets[b])
        if sets[a] and sets[b] and 100 * both >= percent * len(sets[a] | sets[b]):
            x, y = find(a), find(b)
            root[max(x, y)] = min(x, y)
    return {doc: (len(sets[doc]), find(doc)) for doc in sets}


def got(frame):
    return {r.doc_id: (r.n_shingles, r.component_id) for r in frame.collect()}


def edited(text, rng, n):
    words = text.split()
    for k in rng.sample(range(len(words)), n):
        words[k] = f"new{rng.random()}"
    return " ".join(words)


@pytest.fixture(scope="module")
def near(documents):
    """Texts with copies at all distances: long and short ones, chains, a large group of copies
    that are alike without reaching the limit, and exact copies in another case and spacing.
    """
    rng, rows = random.Random(5), []
    add = lambda text: rows.append((len(rows), text, "en", "s0"))
    for k in range(12):
        base = prose(100 + k, rng.choice([8, 30, 120, 400]))
        add(base)
        add(base.upper().replace(" ", "  \n"))
        for _ in range(4):
            add(edited(base, rng, rng.choice([0, 1, 1, 2, 3])))
    chain = prose(300, 400)
    for _ in range(6):
        chain = edited(chain, rng, 4)
        add(chain)
    base = prose(400, 300)
    for _ in range(60):
        add(edited(base, rng, rng.choice([5, 6, 8])))
    for text in ("", None, " \t", "one", "One", "one two three four", "one two three four five"):
        add(text)
    return rows, documents(rows)


def test_components_equal_brute_force(near):
    rows, docs = near
    want = brute(rows)
    assert got(minhash.near_duplicates(docs)) == want
    assert len({c for _, c in want.values()}) < len(rows) - 30


@pytest.mark.parametrize("percent", [60, 100])
def test_other_limits(near, percent):
    rows, docs = near
    assert got(minhash.near_duplicates(docs, percent=percent)) == brute(rows, percent)


def test_signatures_estimate_the_similarity_with_less_variance():
    rng = np.random.default_rng(2)
    for n in (7, 40, 300):
        common, found = int(n * 0.85), []
        for _ in range(80):
            x = np.sort(rng.integers(0, 2 ** 63, 2 * n - common, dtype=np.uint64))
            rng.shuffle(x)
            a, b = np.sort(x[:n]), np.sort(x[n - common:])
            one, two = minhash.signatures([a, b])
            found.append((one == two).mean())
        similarity = common / (2 * n - common)
        independent = (similarity * (1 - similarity) / minhash.SLOTS) ** 0.5
        assert abs(np.mean(found) - similarity) < 4 * independent / 80 ** 0.5
        assert n > minhash.SLOTS or np.std(found) < 0.95 * independent


def test_every_slot_is_the_least_offer_of_full_permutations():
    """The ranks in step give what each element's whole permutation gives."""
    rng = np.random.default_rng(3)
    sets = [np.sort(rng.integers(0, 2 ** 63, n, dtype=np.uint64)) for n in (1, 2, 9, 200, 5000)]
    found = minhash.signatures(sets, 16)
    for elements, row in zip(sets, found):
        least = [2 ** 64] * 16
        draws = [minhash.drawn(elements, rank, 16) for rank in range(16)]
        for i in range(len(elements)):
            order = list(range(16))
            for rank, (place, offer) in enumerate(draws):
                k = int(place[i])
                order[rank], order[k] = order[k], order[rank]
                least[order[rank]] = min(least[order[rank]], int(offer[i]))
        assert row.tolist() == least


def test_words_hash_alike_wherever_a_text_is_cut(monkeypatch):
    rng = random.Random(3)
    monkeypatch.setattr(minhash, "PIECE", 64)
    monkeypatch.setattr(minhash, "LONG", 20)
    known = {}
    for _ in range(200):
        words = ["".join(rng.choices("abABé", k=rng.choice([1, 2, 3, 30, 200]))) for _ in range(rng.randint(0, 30))]
        text = "".join(w + rng.choice([" ", "\n\t", "\r\x0b\x0c "]) for w in words).encode()
        hashes = [h for piece in minhash.pieces(text) for h in minhash.word_hashes(piece)]
        assert len(hashes) == len(text.lower().split())
        for word, value in zip(text.lower().split(), hashes):
            assert known.setdefault(word, value) == value
    assert len(set(known.values())) == len(known)


def test_rare_shingles_lose_no_pair():
    """Any two sets that reach the limit share a shingle among their first ones."""
    rng = random.Random(8)
    for _ in range(300):
        n, percent = rng.randint(1, 40), rng.choice([60, 85, 100])
        a = set(rng.sample(range(60), n))
        b = set(a)
        for x in rng.sample(sorted(a), rng.randint(0, n // 4)):
            b.discard(x)
            b.add(rng.randint(0, 99))
        if 100 * len(a & b) < percent * len(a | b):
            continue
        held = defaultdict(lambda: rng.random())
        first = [set(sorted(s, key=lambda x: held[x])[:len(s) - -(-len(s) * percent // 100) + 1]) for s in (a, b)]
        assert first[0] & first[1]


def test_parity_bits_rule_out_no_pair():
    """They differ in as many places as the sets at most, and in nearly as many for short sets."""
    rng = np.random.default_rng(9)
    for n in (1, 30, 150, 3000):
        x = rng.integers(0, 2 ** 63, 3 * n, dtype=np.uint64)
        a, b = x[:2 * n], x[n:]
        bits = np.unpackbits((minhash.parity(a) ^ minhash.parity(b)).view(np.uint8)).sum()
        assert bits <= 2 * n and (n > 150 or bits > 1.2 * n)


def test_a_group_alike_below_the_limit_is_not_compared_in_pairs(documents, monkeypatch):
    """Copies of one text with own edits: nearly all pairs share rare shingles, few are compared."""
    rng, words = random.Random(6), prose(500, 140).split()
    rows = []
    for k in range(300):
        own = list(words)
        for at in rng.sample(range(140), rng.choice([1, 3, 4, 5])):
            own[at] = f"other{rng.randrange(20)}"
        rows.append((k, " ".join(own)))
    compared, confirm = [], minhash.confirmed
    monkeypatch.setattr(minhash, "confirmed", lambda pairs, *more: compared.append(pairs.count()) or confirm(pairs, *more))
    found = got(minhash.near_duplicates(documents(rows)))
    assert found == brute(rows)
    assert sum(compared) < 6 * len(rows), compared


def test_kept_is_the_documents_that_name_a_component(near):
    _, docs = near
    for r in minhash.near_duplicates(docs).collect():
        assert r.kept == (r.doc_id == r.component_id)


def test_documents_without_id(documents):
    text = prose(1, 50)
    docs = documents([(None, text), (7, text), (None, prose(2, 50)), (None, ""), (3, None)])
    found = sorted((r.doc_id or -1, r.component_id or -1, r.kept) for r in minhash.near_duplicates(docs).collect())
    assert found == [(-1, -1, True), (-1, -1, True), (-1, 7, False), (3, 3, True), (7, 7, True)]
