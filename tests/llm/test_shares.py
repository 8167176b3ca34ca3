"""Packing, mixing and fingerprints beside brute force, and the SQL of the queries."""

import hashlib
import random
from collections import Counter, defaultdict
from itertools import combinations

import pytest
import regex
from pyspark.sql import functions as F

import corpus_pipeline
from __spark_entry__ import queries
from oracle.compare import compare, connect
from orderlens.llm import mixing, packing, spotsigs
from orderlens.llm.common import numbered, table
from orderlens.llm.queries import QUERIES, SQL
from tests.llm.conftest import prose

SF = "/root/testdata/sf0.001"


# -- packing ----------------------------------------------------------------------------


def padding(histogram, bounds):
    return sum(n * (min(b for b in bounds if b >= k) - k) for k, n in histogram.items())


@pytest.mark.parametrize("seed", range(6))
def test_bucket_lengths_are_optimal(seed):
    rng = random.Random(seed)
    histogram = {rng.randint(1, 40): rng.randint(1, 9) for _ in range(9)}
    top = max(histogram)
    for many in (1, 2, 3, 4, 20):
        best = min(padding(histogram, (*some, top)) for n in range(min(many, len(histogram)))
                   for some in combinations([k for k in histogram if k != top], n))
        got = packing.bucket_lengths(histogram, many)
        assert len(got) <= many and padding(histogram, got) == best


def test_packing_loses_nothing(documents):
    rows = [(k, prose(k, 1 + k * 7 % 230)) for k in range(200)] + [(500, None), (501, prose(1, 1000))]
    got = packing.pack(documents(rows), max_len=128, budget=300, buckets=4, cell_rows=7).collect()
    total, batches = Counter(), defaultdict(list)
    for r in got:
        total[r.doc_id] += r.n_tokens
        assert r.padding == r.bucket - r.n_tokens >= 0
        batches[r.bucket, r.batch].append(r)
    assert total == {k: len((t or "").split()) + 1 for k, t in rows}
    for (bucket, _), members in batches.items():
        assert len(members) == 1 or len(members) * bucket <= 300
        assert sorted(m.slot for m in members) == list(range(len(members)))
    for bucket in {b for b, _ in batches}:
        sizes = [len(batches[bucket, k]) for k in range(sum(b == bucket for b, _ in batches))]
        assert all(n == max(1, 300 // bucket) for n in sizes[:-1])
    assert len({b for b, _ in batches}) <= 4


# -- mixing -----------------------------------------------------------------------------


def test_targets_are_reached(documents):
    rng = random.Random(1)
    rows = [(k, prose(k, rng.randint(1, 30)), None, rng.choice(["a", "a", "b", "c", None])) for k in range(600)]
    docs = documents(rows)
    got = mixing.mix_table(docs).join(docs.select("doc_id", "source"), "doc_id").collect()
    taken, target, size = Counter(), {}, Counter()
    for r in got:
        assert r["size"] == len(rows[r.doc_id][1].split()) and r.taken <= 2 * r["size"]
        taken[r.source] += r.taken
        size[r.source] += r["size"]
        target[r.source] = r.target
    for source in target:
        assert target[source] <= 2 * size[source] + 1e-6
        assert abs(taken[source] - target[source]) <= 16
    assert sum(target.values()) == pytest.approx(1.5 * sum(size.values()))


def test_shares_follow_the_weights(spark):
    sizes = spark.createDataFrame([("a", 1000), ("b", 1000), ("c", 1000), (None, 10)], "source string, size long")
    got = {r.source: r.target for r in mixing.source_targets(sizes, (5.0, 2.0, 1.0), 0.5, 2.0).collect()}
    # The missing source is the fourth and weighs 5 again, but stops at 20.
    assert got[None] == 20 and got["a"] == pytest.approx(5 / 8 * 1485) and got["c"] == pytest.approx(1485 / 8)


def test_mix_repeats_rows(documents):
    docs = documents([(k, prose(k, 9), "en", f"s{k % 2}") for k in range(40)])
    want = {r.doc_id: r.taken // r["size"] for r in mixing.mix_table(docs).collect()}
    got = Counter(r.doc_id for r in mixing.mix(docs).collect())
    assert got == {k: n for k, n in want.items() if n}


def plain_mix(rows, divide=True, seed="mix"):
    """Copies per row and inclusion per row, by definition: (source, size, key) rows."""
    def md5(text):
        return hashlib.md5(text.encode()).hexdigest()

    words = [len(regex.findall(r"[^\x20\x09-\x0D]+", r[1] or "")) for r in rows]
    sources = sorted({r[3] for r in rows}, key=lambda x: (x is None, x))
    held = {x: sum(w for w, r in zip(words, rows) if r[3] == x) for x in sources}
    weight = {x: (5.0, 2.0, 1.0)[k % 3] for k, x in enumerate(sources)}
    target, left = {}, min(1.5 * sum(held.values()), 2.0 * sum(held.values()))
    while True:
        level = left / sum(w for x, w in weight.items() if x not in target)
        over = [x for x in sources if x not in target and weight[x] * level >= 2 * held[x]]
        if not over:
            break
        for x in over:
            target[x], left = 2.0 * held[x], left - 2.0 * held[x]
        if len(target) == len(sources):
            break
    target |= {x: weight[x] * level for x in sources if x not in target}
    copies, inclusion, seen = [0] * len(rows), [0.0] * len(rows), Counter()
    us = []
    for r in rows:
        key = md5(f"{seed}:{'' if r[0] is None else r[0]}:{md5(r[1] or '')}")
        us.append((int(md5(f"{key}:{seen[r[3], key]}")[:12], 16) + 0.5) / 16 ** 12)
        seen[r[3], key] += 1
    for x in sources:
        members = [k for k, r in enumerate(rows) if r[3] == x and words[k]]
        if not members:
            continue
        whole = int(target[x] // held[x])
        rest, open_ = target[x] - whole * held[x], list(members)
        while True:
            rate = rest / sum(words[k] ** 1.5 for k in open_)
            certain = [k for k in open_ if rate * words[k] ** 0.5 >= 1]
            if not certain:
                break
            # The largest leave first, since they are certain at every later rate.
            big = max(words[k] for k in certain)
            certain = [k for k in certain if words[k] == big]
            rest -= sum(words[k] for k in certain)
            open_ = [k for k in open_ if words[k] != big]
        for k in members:
            copies[k] = whole + (k not in open_)
            inclusion[k] = 1.0 if k not in open_ else rate * words[k] ** 0.5

        def rank(k):
            odds = us[k] / (1 - us[k])
            return odds / (inclusion[k] / (1 - inclusion[k])) if divide and rest > 1e-9 else odds

        total = 0
        for k in sorted(open_, key=rank):
            total += words[k]
            copies[k] += rest > 1e-9 and total - rest <= words[k] / 2
    return copies, inclusion


def mixture(rng, n=900):
    """Documents of uneven sizes, a third of them from one source."""
    return [(k, prose(k, rng.choice([1, 2, 3, 5, 8, 40, 300] if k % 9 == 0 else [1, 2, 3, 5, 8])), None,
             rng.choice(["a", "b", "c", "d", None, "a"])) for k in range(n)]


def test_mix_matches_brute_force(documents):
    rows = mixture(random.Random(4)) + [(900, None, None, "a"), (901, "", None, "b")]
    want, inclusion = plain_mix(rows)
    got = {r.doc_id: r for r in mixing.with_copies(documents(rows)).collect()}
    assert [got[r[0]].copies for r in rows] == want
    for r, pi in zip(rows, inclusion):
        if pi:
            assert got[r[0]].inclusion == pytest.approx(pi)


def test_inclusions_differ_and_decide(documents):
    rows = mixture(random.Random(5))
    want, inclusion = plain_mix(rows)
    assert any(len({round(pi, 9) for pi, r in zip(inclusion, rows) if r[3] == x and 0 < pi < 1}) > 2 for x in "abcd")
    assert any(pi == 1.0 for pi in inclusion)
    # Ranking by the random odds alone draws other documents.
    assert plain_mix(rows, divide=False)[0] != want


def test_documents_are_drawn_at_their_inclusions(documents):
    rng = random.Random(6)
    rows = [(k, prose(k, rng.choice([1, 4, 9, 16])), None, "a" if k % 10 else "b") for k in range(6000)]
    drawn, wanted, many = Counter(), {}, Counter()
    for r in mixing.with_copies(documents(rows), weights=(1.0, 9.0), share=0.5).collect():
        drawn[r.source, r["size"]] += r.copies
        many[r.source, r["size"]] += 1
        wanted[r.source, r["size"]] = r.inclusion
    groups = [g for g in many if g[0] == "a"]
    assert len({round(wanted[g], 6) for g in groups}) == 4
    for g in groups:
        error = (wanted[g] * (1 - wanted[g]) / many[g]) ** 0.5
        assert abs(drawn[g] / many[g] - wanted[g]) < 4 * error


def test_repeated_rows_are_told_apart(documents):
    text = "one two three four five"
    rows = ([(7, text, None, "a")] * 1000 + [(None, text, None, "b")] * 700
            + [(None, prose(k, 5), None, "b") for k in range(300)]
            + [(k, prose(k, 5), None, "c") for k in range(1000, 2000)])
    taken, target = Counter(), {}
    for r in mixing.with_copies(documents(rows), share=0.8).collect():
        taken[r.source] += r["size"] * r.copies
        target[r.source] = r.target
    for source, wanted in target.items():
        assert abs(taken[source] - wanted) <= 5
    copies = Counter(r.source for r in mixing.mix(documents(rows), share=0.8).collect())
    assert {s: 5 * n for s, n in copies.items()} == dict(taken)


# -- fingerprints -----------------------------------------------------------------------


def plain_signatures(text):
    words = [w for w in regex.split(r"[^\p{L}\p{N}]+", text.lower()) if w]
    content, starts, after = [], set(), True
    for w in words:
        if w in spotsigs.ANCHORS:
            after = True
            continue
        if after:
            starts.add(len(content))
        after = False
        content.append(w)
    found = {(content[k], content[k + 1]) for k in starts if k + 1 < len(content)}
    return found or ({tuple(words)} if words else set())


def test_fingerprints_match_brute_force(documents):
    texts = [prose(k, 5 + 9 * k) for k in range(15)] + [None, "", "the", "of the and", "one the", "the two",
             "The, one! of THE two;", "ÄB the öl und 7x la", prose(3, 32), "?"]
    rows = [(k * 3, t) for k, t in enumerate(texts)]
    got = {r.doc_id: r for r in spotsigs.edits_table(documents(rows)).collect()}
    like = lambda a, b: 1.0 if not a and not b else len(a & b) / len(a | b)
    plain = [t or "" for t in texts]
    for k, text in enumerate(plain):
        following = plain[(k + 1) % len(plain)]
        cut = len(text) // 4
        edited = text[:len(text) - cut] + following[:cut]
        r, own = got[k * 3], plain_signatures(text)
        assert r.n_chars == len(text)
        assert r.edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        assert r.near_edited == pytest.approx(like(own, plain_signatures(edited)))
        assert r.near_next == pytest.approx(like(own, plain_signatures(following)))
    same = defaultdict(set)
    for k, text in enumerate(plain):
        same[frozenset(plain_signatures(text))].add(got[k * 3].fingerprint)
    assert all(len(x) == 1 for x in same.values()) and len(set().union(*same.values())) == len(same)


def test_texts_without_anchors_are_covered_whole(documents):
    def listed(k, n):
        return " ".join(f"w{k}x{j}" for j in range(n))

    texts = ["same start " + listed(1, 80), "same start " + listed(2, 80), "The same start " + listed(3, 80),
             listed(4, 20) + " the", "one two", "three the", "one two q r s t", "one two u v w x"]
    got = [r for r in sorted(spotsigs.edits_table(documents(list(enumerate(texts)))).collect(),
                             key=lambda r: r.doc_id)]
    assert len({r.fingerprint for r in got}) == len(texts)
    assert got[0].near_next == pytest.approx(1 / 161) and got[1].near_next == pytest.approx(1 / 161)
    assert all(0.4 < r.near_edited < 1 and r.fingerprint != r.edited_fingerprint for r in got[:3])


@pytest.mark.parametrize("least", [0.0, 0.5, 0.8])
def test_pruning_loses_no_similar_pair(spark, least):
    rng = random.Random(2)
    rows = [(rng.sample(range(12), rng.randint(0, 12)), rng.sample(range(12), rng.randint(0, 12)))
            for _ in range(400)]
    frame = spark.createDataFrame(rows, "a array<bigint>, b array<bigint>")
    got = frame.select("a", "b", spotsigs.likeness(F.col("a"), F.col("b"), least).alias("x")).collect()
    for r in got:
        a, b = set(r.a), set(r.b)
        exact = len(a & b) / len(a | b) if a | b else 1.0
        assert r.x == pytest.approx(exact) or (r.x == 0 and exact < least)


@pytest.mark.parametrize("least", [0.5, 0.8])
def test_near_pairs_match_brute_force(documents, least):
    rng, texts = random.Random(3), [None, "", "one two", "the", prose(1, 60), prose(1, 60)]
    for base in range(8):
        for _ in range(6):
            words = prose(base, 120).split()
            for _ in range(rng.randint(0, 4)):
                words[rng.randrange(len(words))] = "changed"
            texts.append(" ".join(words[:rng.randint(90, 120)]))
    docs = documents([(k * 50, t) for k, t in enumerate(texts)])
    prints = {r.doc_id: r.fingerprint for r in spotsigs.edits_table(docs).collect()}
    sets = {prints[k * 50]: plain_signatures(t or "") for k, t in enumerate(texts)}
    want = {frozenset((a, b)): len(sets[a] & sets[b]) / len(sets[a] | sets[b])
            for a in sets for b in sets if a < b and sets[a] | sets[b]}
    want = {pair: x for pair, x in want.items() if x >= least}
    got = spotsigs.near_pairs(docs, least).collect()
    assert len(got) == len(want) > 20
    assert {frozenset((r.fingerprint_a, r.fingerprint_b)): r.near for r in got} == pytest.approx(want)


def test_long_runs_of_anchors(documents):
    docs = documents([(1, "the " * 200_000), (2, "the " * 100_000 + "end of it now")])
    assert spotsigs.edits_table(docs).count() == 2


def test_rows_are_numbered_in_order(spark):
    frame = spark.range(1000).select((F.col("id") * 7 % 1000).alias("x")).repartition(6)
    got = numbered(frame, ["x"]).collect()
    assert all(r.rn == r.x for r in got)


# -- registered queries -----------------------------------------------------------------


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_matches_sql(spark, name):
    assert compare(QUERIES[name](spark, SF), connect(SF), SQL[name]) == []


def test_all_are_registered():
    assert set(QUERIES) | {"pipeline"} <= set(queries())
    assert sorted(int(name[2:].split("_")[0]) for name in QUERIES) == list(range(1, 14))


@pytest.mark.parametrize("name", ["op6_spotsigs", "op7_mixing"])
def test_native_queries_run_no_python(spark, name):
    plan = QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert not any(word in plan for word in ("Python", "Arrow", "Pandas"))


def test_pipeline_keeps_clean_documents(spark):
    docs = table(spark, SF, "documents")
    labels = table(spark, SF, "labels")
    kept = dict(corpus_pipeline.STAGES)["quality"](spark, docs, SF)
    clean = labels.where("quality = 1").join(docs, "doc_id").count()
    assert kept.join(labels.where("quality = 1"), "doc_id").count() >= 0.97 * clean
    assert corpus_pipeline.run(spark, SF).count() > 0
