"""The prefix trie of conversations by fixed-length block hashing.

A conversation is cut into blocks of a fixed number of turns. Every turn has a digest that is bound
to its position, a block's digest is the sum of its turns' digests, and the sum of the blocks
before it names what precedes a block: its state. Conversations are grouped by state and block
digest first. Where all that go on from a state have the same block, its turn boundaries are the
group's own and need no further grouping; only the blocks of a state where siblings diverge are
refined into their turns, which are grouped by the digests up to each turn. Digests have 120 bits.

A node belongs to its smallest member, and the nodes of one member are a path downwards: its
conversation from where it leaves a smaller one. So the trie is a tree of such paths. Sums over
whole paths and all that hangs from them come from pointer doubling over that tree, in as
many rounds as the logarithm of its height, and sums over a node's subtree from running sums up
its path. Running sums are taken over ranges of the order with an offset for each
(``running``), so a conversation of any length, or one that very many share, fits no single task.

Defined cases: a missing role or text is empty; turns are in order of turn (missing ones first),
then of role, then of a digest of role and text, and repeated rows are turns of their own; rows
without conv_id take no part; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from orderlens.llm.common import stored

#: Turns in a block.
BLOCK = 8
WIDE = "decimal(38,0)"


def running(frame: DataFrame, key: list[str], order: list[Column], sums: dict[str, Column]) -> DataFrame:
    """Adds, under each name, the sum of its column over the earlier rows of the same key. The
    rows are dealt by ranges of key and order and summed up in their range; a key that goes on
    over several ranges has the sums of the earlier ones added.
    """
    values = {f"{name}__own": column.cast(WIDE) for name, column in sums.items()}
    dealt = stored(frame.withColumns(values).repartitionByRange(*[F.col(c) for c in key], *order)
                   .withColumn("part__", F.spark_partition_id()), "ranges")
    window = Window.partitionBy(*key).orderBy("part__").rowsBetween(Window.unboundedPreceding, -1)
    parts = dealt.groupBy(*key, "part__").agg(*[F.sum(f"{name}__own").alias(f"{name}__part") for name in sums])
    before = parts.select(*key, "part__", *[
        F.coalesce(F.sum(f"{name}__part").over(window), F.lit(0)).alias(f"{name}__before") for name in sums])
    earlier = Window.partitionBy(*key, "part__").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return (dealt.withColumns({f"{name}__in": F.coalesce(F.sum(f"{name}__own").over(earlier), F.lit(0))
                               for name in sums})
            .join(before, [*key, "part__"])
            .withColumns({name: (F.col(f"{name}__in") + F.col(f"{name}__before")).cast(WIDE) for name in sums})
            .select(*frame.columns, *sums))


def turns_of(rows: DataFrame) -> DataFrame:
    """conv_id, pos (from 0), digest of role and text, n_chars of the text."""
    role, text = (F.coalesce(c, F.lit("")) for c in ("role", "text"))
    digest = F.md5(F.concat(F.length(role).cast("string"), F.lit(":"), role, text).cast("binary"))
    narrow = rows.where("conv_id IS NOT NULL").select(
        F.col("conv_id").cast("long"), "turn", role.alias("role"), digest.alias("digest"),
        F.length(text).cast("long").alias("n_chars"))
    order = [F.col("turn").asc_nulls_first(), F.col("role").asc(), F.col("digest").asc()]
    return running(narrow, ["conv_id"], order, {"pos": F.lit(1)}).select(
        "conv_id", F.col("pos").cast("long").alias("pos"), "digest", "n_chars")


def rebuilt(turns: DataFrame, head: Column, base: Column, most: int) -> tuple[DataFrame, DataFrame]:
    """The turns after every conversation's first ``head`` ones are replaced by those of the
    conversation ``base``; and all conv_ids. ``most`` is the largest head.
    """
    convs = stored(turns.groupBy("conv_id").agg(F.count("*").alias("own")), "conversations")
    first = (turns.where(F.col("pos") < most).groupBy("conv_id")
             .agg(F.sort_array(F.collect_list(F.struct("pos", "digest", "n_chars"))).alias("first"))
             .withColumnRenamed("conv_id", "base"))
    asked = convs.withColumns({"head": head.cast("int"), "base": base}).join(first, "base", "left")
    taken = F.slice(F.coalesce("first", F.array().cast("array<struct<pos:long,digest:string,n_chars:long>>")),
                    F.lit(1), F.col("head"))
    replaced = stored(asked.select("conv_id", "head", taken.alias("taken")), "replaced")
    heads = replaced.select("conv_id", F.explode("taken").alias("one")).select("conv_id", "one.*")
    shift = replaced.select("conv_id", "head", F.size("taken").alias("n_taken"))
    tails = (turns.join(shift, "conv_id").where("pos >= head")
             .select("conv_id", (F.col("pos") - F.col("head") + F.col("n_taken")).alias("pos"), "digest", "n_chars"))
    return heads.unionByName(tails), convs.select("conv_id")


def lanes(digest: Column) -> dict[str, Column]:
    """Two halves of a digest as numbers of 60 bits."""
    return {name: F.conv(F.substring(digest, at, 15), 16, 10).cast(WIDE) for name, at in (("x", 1), ("y", 17))}


def nodes_of(turns: DataFrame, convs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The nodes (depth, x, y, up_x, up_y, conv_id, n_convs, n_chars), x and y naming the turns down
    to a node and up_x, up_y its parent; and where each conversation ends (conv_id, depth, x, y).
    """
    bound = lanes(F.md5(F.concat_ws(":", "pos", "digest").cast("binary")))
    placed = turns.withColumns({**bound, "block": F.floor(F.col("pos") / BLOCK)})
    blocks = placed.groupBy("conv_id", "block").agg(
        F.sort_array(F.collect_list(F.struct("pos", "x", "y", "n_chars"))).alias("turns"),
        F.sum("x").cast(WIDE).alias("block_x"), F.sum("y").cast(WIDE).alias("block_y"))
    states = stored(running(blocks, ["conv_id"], [F.col("block").asc()],
                            {"state_x": F.col("block_x"), "state_y": F.col("block_y")}), "blocks")
    ends = (states.groupBy("conv_id").agg(F.max(F.struct(
        (F.col("block") * BLOCK + F.size("turns")).alias("depth"), (F.col("state_x") + F.col("block_x")).cast(WIDE).alias("x"),
        (F.col("state_y") + F.col("block_y")).cast(WIDE).alias("y"))).alias("end")).select("conv_id", "end.*"))
    ends = (convs.join(ends, "conv_id", "left").select(
        "conv_id", F.coalesce("depth", F.lit(0)).cast("long").alias("depth"),
        *[F.coalesce(c, F.lit(0)).cast(WIDE).alias(c) for c in ("x", "y")]))

    state = ["block", "state_x", "state_y"]
    groups = stored(states.groupBy(*state, "block_x", "block_y").agg(
        F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs"), F.first("turns").alias("turns")), "groups")
    several = groups.groupBy(*state).agg((F.count("*") > 1).alias("diverge"))
    here = groups.join(several, state)
    # Each turn of a block with the sums of the block's turns up to it.
    spread = here.select(*state, "conv_id", "n_convs", "diverge", "turns", F.posexplode("turns").alias("k", "turn"))
    zero = F.lit(0).cast(WIDE)

    def upto(lane, last):
        inside = F.aggregate(F.slice("turns", F.lit(1), last), zero, lambda a, t: (a + t[lane]).cast(WIDE))
        return (F.col(f"state_{lane}") + inside).cast(WIDE)

    rows = spread.select(
        "diverge", "conv_id", "n_convs", (F.col("turn.pos") + 1).alias("depth"), F.col("turn.n_chars").alias("n_chars"),
        *[upto(lane, F.col("k") + 1).alias(lane) for lane in ("x", "y")],
        *[upto(lane, F.col("k")).alias(f"up_{lane}") for lane in ("x", "y")])
    columns = ["depth", "x", "y", "up_x", "up_y", "conv_id", "n_convs", "n_chars"]
    refined = (rows.where("diverge").groupBy("depth", "x", "y", "up_x", "up_y")
               .agg(F.min("conv_id").alias("conv_id"), F.sum("n_convs").alias("n_convs"),
                    F.first("n_chars").alias("n_chars")))
    root = convs.agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs")).where("n_convs > 0").select(
        F.lit(0).cast("long").alias("depth"), zero.alias("x"), zero.alias("y"), F.lit(None).cast(WIDE).alias("up_x"),
        F.lit(None).cast(WIDE).alias("up_y"), "conv_id", "n_convs", F.lit(0).cast("long").alias("n_chars"))
    alone = rows.where("NOT diverge").select(*columns)
    return alone.unionAll(refined.select(*columns)).unionAll(root.select(*columns)), ends


def with_parents(nodes: DataFrame) -> DataFrame:
    """Adds parent_conv_id and n_children."""
    parent = nodes.select((F.col("depth") + 1).alias("depth"), F.col("x").alias("up_x"), F.col("y").alias("up_y"),
                          F.col("conv_id").alias("parent_conv_id"))
    children = nodes.groupBy((F.col("depth") - 1).alias("depth"), F.col("up_x").alias("x"), F.col("up_y").alias("y")).agg(
        F.count("*").alias("n_children"))
    return (nodes.join(parent, ["depth", "up_x", "up_y"], "left").join(children, ["depth", "x", "y"], "left")
            .withColumn("n_children", F.coalesce("n_children", F.lit(0))))


def path_totals(paths: DataFrame, sums: list[str]) -> DataFrame:
    """conv_id and the sums of its path and of all paths that hang from it, directly or not, from
    (conv_id, up, sums): up is the path it hangs from. By pointer doubling.
    """
    totals = stored(paths, "paths")
    while not totals.where("up IS NOT NULL").isEmpty():
        gained = totals.where("up IS NOT NULL").groupBy(F.col("up").alias("conv_id")).agg(
            *[F.sum(c).alias(f"more_{c}") for c in sums])
        next_up = totals.select(F.col("conv_id").alias("up"), F.col("up").alias("next"))
        totals = stored(
            totals.join(gained, "conv_id", "left").join(next_up, "up", "left").select(
                "conv_id", F.col("next").alias("up"),
                *[(F.col(c) + F.coalesce(f"more_{c}", F.lit(0))).cast("long").alias(c) for c in sums]), "paths")
    return totals.select("conv_id", *sums)


def subtree_sums(nodes: DataFrame) -> DataFrame:
    """Adds n_leaves and saved_tokens of every node's subtree, itself included."""
    own = nodes.withColumns({"leaves": (F.col("n_children") == 0).cast("long"),
                             "saved": (F.col("n_convs") - 1) * F.col("n_chars")})
    top = F.min(F.when(F.col("parent_conv_id") != F.col("conv_id"),
                       F.struct((F.col("depth") - 1).alias("at"), F.col("parent_conv_id").alias("up"))))
    paths = stored(own.groupBy("conv_id").agg(
        F.sum("leaves").alias("leaves"), F.sum("saved").alias("saved"), top.alias("top")), "tops")
    whole = path_totals(paths.select("conv_id", "top.up", "leaves", "saved"), ["leaves", "saved"])
    hanging = (whole.join(paths.select("conv_id", "top"), "conv_id").where("top IS NOT NULL")
               .groupBy(F.col("top.up").alias("conv_id"), F.col("top.at").alias("depth"))
               .agg(F.sum("leaves").alias("more_leaves"), F.sum("saved").alias("more_saved")))
    here = own.join(hanging, ["conv_id", "depth"], "left").withColumns({
        c: F.col(c) + F.coalesce(f"more_{c}", F.lit(0)) for c in ("leaves", "saved")})
    below = running(here.drop("more_leaves", "more_saved"), ["conv_id"], [F.col("depth").desc()],
                    {"leaves_below": F.col("leaves"), "saved_below": F.col("saved")})
    return below.withColumns({
        "n_leaves": (F.col("leaves") + F.col("leaves_below")).cast("long"),
        "saved_tokens": (F.col("saved") + F.col("saved_below")).cast("long")})


def end_hashes(ends: DataFrame) -> DataFrame:
    """depth, x, y, ends_sha256 of the nodes at which conversations (conv_id, depth, x, y) end:
    their decimal ids, ascending, joined by commas. The ids are put together by ranges, and the
    ranges of one node are hashed one after the other.
    """
    key = ["depth", "x", "y"]
    ranges = (ends.repartitionByRange(*key, "conv_id").withColumn("part", F.spark_partition_id())
              .groupBy(*key, "part").agg(F.sort_array(F.collect_list("conv_id")).alias("ids"))
              .select(*key, "part", F.concat_ws(",", F.transform("ids", lambda c: c.cast("string"))).alias("ids")))

    def hashed(batches):
        state, sha = None, None
        for batch in batches:
            done = []
            for depth, x, y, ids in zip(*(batch.column(c).to_pylist() for c in (*key, "ids"))):
                if (depth, x, y) != state:
                    if state:
                        done.append((*state, sha.hexdigest()))
                    state, sha = (depth, x, y), hashlib.sha256()
                else:
                    sha.update(b",")
                sha.update(ids.encode())
            yield batch_of(done)
        if state:
            yield batch_of([(*state, sha.hexdigest())])

    def batch_of(rows):
        kinds = pa.schema([("depth", pa.int64()), ("x", pa.decimal128(38, 0)), ("y", pa.decimal128(38, 0)),
                           ("ends_sha256", pa.string())])
        return pa.RecordBatch.from_pylist([dict(zip(kinds.names, r)) for r in rows], kinds)

    return (ranges.repartition(*key).sortWithinPartitions(*key, "part").select(*key, "ids")
            .mapInArrow(hashed, f"depth long, x {WIDE}, y {WIDE}, ends_sha256 string"))


def trie(turns: DataFrame, convs: DataFrame) -> DataFrame:
    """A row per node of the prefix trie of the turns (conv_id, pos, digest, n_chars) of all
    conversations (conv_id).
    """
    nodes, ends = nodes_of(turns, convs)
    nodes = stored(with_parents(stored(nodes, "nodes")), "linked")
    ends = stored(ends, "ends")
    empty = hashlib.sha256().hexdigest()
    return (subtree_sums(nodes).join(end_hashes(ends), ["depth", "x", "y"], "left").select(
        "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens",
        F.coalesce("ends_sha256", F.lit(empty)).alias("ends_sha256")))


def trie_table(rows: DataFrame) -> DataFrame:
    """The trie of a conversations table in which every conversation starts with turns of the
    one whose id is the hundred below its own.
    """
    c = F.col("conv_id")
    head = F.crc32(c.cast("string").cast("binary")) % 6
    turns = stored(turns_of(rows), "turns")
    return trie(*rebuilt(turns, head, c - c % 100, 5))


SQL = """
WITH own AS (
  SELECT conv_id, coalesce(role, '') AS role, coalesce("text", '') AS txt,
    row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce("text", '')) - 1 AS pos
  FROM conversations WHERE conv_id IS NOT NULL),
convs AS (
  SELECT conv_id, conv_id - conv_id % 100 AS base,
    xor(list_reduce(list_transform(string_split(conv_id::VARCHAR, ''), lambda c: ascii(c)::BIGINT),
      lambda crc, b: list_reduce(range(8),
        lambda v, k: xor(v >> 1, CASE WHEN v & 1 = 1 THEN 3988292384 ELSE 0 END), xor(crc, b)),
      4294967295::BIGINT), 4294967295) % 6 AS h
  FROM (SELECT DISTINCT conv_id FROM own)),
heads AS (
  SELECT c.conv_id, o.pos, o.role, o.txt FROM convs c JOIN own o ON o.conv_id = c.base AND o.pos < c.h),
taken AS (SELECT conv_id, count(*) AS n FROM heads GROUP BY conv_id),
turns AS (
  SELECT conv_id, pos, role, txt FROM heads
  UNION ALL
  SELECT o.conv_id, o.pos - c.h + coalesce(t.n, 0), o.role, o.txt
  FROM own o JOIN convs c USING (conv_id) LEFT JOIN taken t USING (conv_id) WHERE o.pos >= c.h),
digests AS (SELECT conv_id, pos + 1 AS depth, length(txt) AS chars, md5(length(role) || ':' || role || txt) AS d FROM turns),
paths AS (
  SELECT conv_id, depth, chars,
    md5(string_agg(d, '' ) OVER (PARTITION BY conv_id ORDER BY depth)) AS node FROM digests
  UNION ALL SELECT conv_id, 0, 0, '' FROM convs),
lengths AS (SELECT conv_id, max(depth) AS len FROM paths GROUP BY conv_id),
nodes AS (
  SELECT node, depth, min(p.conv_id) AS conv_id, count(*) AS n_convs, any_value(chars) AS chars,
    sha256(coalesce(string_agg(CASE WHEN len = depth THEN p.conv_id::VARCHAR END, ',' ORDER BY p.conv_id), '')) AS ends_sha256
  FROM paths p JOIN lengths USING (conv_id) GROUP BY node, depth),
linked AS (
  SELECT n.*, q.node AS up FROM nodes n LEFT JOIN paths q ON q.conv_id = n.conv_id AND q.depth = n.depth - 1),
children AS (SELECT up AS node, count(*) AS n_children FROM linked WHERE up IS NOT NULL GROUP BY up),
whole AS (
  SELECT a.node, sum(CASE WHEN c.n_children IS NULL THEN 1 ELSE 0 END)::BIGINT AS n_leaves,
    sum((n.n_convs - 1) * n.chars)::BIGINT AS saved_tokens
  FROM nodes n JOIN paths a ON a.conv_id = n.conv_id AND a.depth <= n.depth
    LEFT JOIN children c ON c.node = n.node
  GROUP BY a.node)
SELECT l.conv_id, l.depth::BIGINT AS depth, p.conv_id AS parent_conv_id, l.n_convs,
  coalesce(c.n_children, 0) AS n_children, w.n_leaves, w.saved_tokens, l.ends_sha256
FROM linked l LEFT JOIN nodes p ON p.node = l.up LEFT JOIN children c ON c.node = l.node JOIN whole w ON w.node = l.node
"""
