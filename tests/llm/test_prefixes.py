"""The prefix trie beside one built turn by turn."""

import hashlib
import random
import zlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from orderlens.llm import prefixes

SCHEMA = "conv_id long, turn long, role string, text string"


def rebuilt(rows):
    own = defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            own[conv].append((turn is not None, turn or 0, role or "", text or ""))
    turns = {c: [(r, t) for _, _, r, t in sorted(x)] for c, x in own.items()}
    out = {}
    for c, mine in turns.items():
        h = zlib.crc32(str(c).encode()) % 6
        base = c - (abs(c) % 100) * (1 if c >= 0 else -1)
        out[c] = turns.get(base, [])[:h] + mine[h:]
    return out


def brute(rows):
    convs = rebuilt(rows)
    members = defaultdict(list)
    for c, turns in convs.items():
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].append(c)
    children = defaultdict(list)
    for node in members:
        if node:
            children[node[:-1]].append(node)

    def under(node):
        for child in children[node]:
            yield from under(child)
        yield node

    out = []
    for node, found in members.items():
        below = list(under(node))
        ends = ",".join(map(str, sorted(c for c in found if len(convs[c]) == len(node))))
        out.append((min(found), len(node), min(members[node[:-1]]) if node else None, len(found), len(children[node]),
                    sum(not children[b] for b in below),
                    sum((len(members[b]) - 1) * len(b[-1][1]) for b in below if b),
                    hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=repr)


def built(spark, rows):
    frame = spark.createDataFrame(rows, SCHEMA).withColumns({
        "depth": F.lit(1), "x": F.lit("x"), "pos": F.lit(2), "block": F.lit(3), "n_convs": F.lit(4)})
    got = prefixes.trie_table(frame.repartition(3))
    return sorted(map(tuple, got.collect()), key=repr)


def conversations(seed, n, longest=5):
    """Few different turns, so that conversations share and leave each other at all depths."""
    rng, rows = random.Random(seed), []
    for c in rng.sample(range(600), n):
        for turn in range(rng.randint(1, longest)):
            rows.append((c, turn, rng.choice(["user", "bot"]), rng.choice(["a", "bb", "cé\U0001f600"])))
    return rows


@pytest.mark.parametrize("block", [1, 3, 8])
def test_equals_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(prefixes, "BLOCK", block)
    rows = conversations(block, 60, 12)
    assert built(spark, rows) == brute(rows)


def test_shared_long_conversations(spark):
    """Many equal ones, which end at one node, and ones that go on or leave in mid-block."""
    common = [("user" if k % 2 else "bot", f"turn {k % 4}") for k in range(30)]
    rows = []
    for c in range(0, 400, 100):
        for k in range(30):
            rows.append((c, k, *common[k]))
    for c in range(1, 30):
        rows += [(c, k, *common[k]) for k in range(30 if c % 3 else 11)]
        rows += [(c, 40, "user", f"own {c % 5}")] * (c % 4 == 1)
    assert built(spark, rows) == brute(rows)


def test_odd_rows(spark):
    rows = [(7, None, None, None), (7, None, "user", None), (7, 0, "user", "x"), (7, 0, "user", "x"), (7, 0, "user", "a"),
            (107, 5, "", ""), (207, 1, "user", "y"), (200, 1, "bot", "z"), (None, 1, "user", "lost"), (-5, 1, "a", "b"),
            (-5, 2, "a", "b"), (0, 1, "user", "long" * 5000), (1, 1, "u", "t"), (2, 1, "u", "t"), (3, 1, "u", "t")]
    assert built(spark, rows) == brute(rows)
    empty = spark.createDataFrame([], SCHEMA)
    assert prefixes.trie_table(empty).count() == 0


def test_only_turnless_conversations(spark):
    """Heads longer than the conversations and no base to take turns from."""
    rows = [(c, 0, "user", "gone") for c in range(101, 160) if zlib.crc32(str(c).encode()) % 6][:20]
    want = brute(rows)
    assert len(want) == 1 and want[0][:5] == (rows[0][0], 0, None, 20, 0)
    assert built(spark, rows) == want


def test_running_sums_go_on_over_ranges(spark):
    """A key that holds most rows lies in several ranges."""
    rows = spark.range(5000).selectExpr("CASE WHEN id % 5 > 0 THEN 1 ELSE id END AS k", "id AS o", "id % 7 AS v")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = prefixes.running(rows, ["k"], [F.col("o").asc()], {"before": F.col("v")}).collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    total = defaultdict(int)
    want = {}
    for r in sorted(got, key=lambda r: r.o):
        want[r.o] = total[r.k]
        total[r.k] += r.v
    assert len(got) == 5000 and {r.o: int(r.before) for r in got} == want


def test_only_diverging_blocks_are_refined(spark):
    """Conversations that are alike to the end have nodes without a grouping by turns."""
    rows = [(c, k, "user", f"t{k}") for c in range(1, 40) for k in range(20)]
    turns = prefixes.turns_of(spark.createDataFrame(rows, SCHEMA))
    nodes, ends = prefixes.nodes_of(turns, turns.select("conv_id").distinct())
    assert nodes.count() == 21 and {r.n_convs for r in nodes.collect()} == {39}
    assert ends.select("depth", "x", "y").distinct().count() == 1
