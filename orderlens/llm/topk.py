"""Exact top-k search by inner product with a three-phase uniform threshold.

A vector's components are split into two score lists; a score is the sum of the local scores
that the lists give. Phase one gathers every list's best entries for each query and adds them
up in full: the k-th best sum is a safe cutoff. Phase two sends the cutoff to both lists; a
vector that reaches it has at least half of it in one of them, and all such entries are
collected. Phase three resolves each entry in the other list, exactly, and keeps what
reaches the cutoff.

Queries and vectors meet in blocks: a task holds one list's part of one block of each.
Equal vectors are one candidate that keeps its k + 1 smallest ids, and equal queries are one
query, so a vector that holds a third of all rows is scored once.

Defined cases: a vector that is missing, or holds a missing or non-finite component, and a
row without vec_id take no part; shorter vectors count as padded with zeros; rows repeated
whole are one row; rows that share the query's vec_id are its own, and its different vectors
are ranked together; scores are exact while they fit a long; an empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from orderlens.llm.common import in_arrow, stored

SCALE = 64.0
LISTS = 2
VECTORS_IN_BLOCK = 4096
QUERIES_IN_BLOCK = 1024


def quantised(rows: DataFrame) -> DataFrame:
    """(vec_id, v): components floor(64 * x) as packed longs, trailing zeros left out."""
    def work(batch):
        ids, packed = [], []
        for vec_id, x in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            if vec_id is None or x is None or any(c is None for c in x):
                continue
            scaled = SCALE * np.array(x, dtype=np.float64)
            if np.isfinite(scaled).all():
                whole = np.trim_zeros(np.floor(scaled).clip(-2.0 ** 62, 2.0 ** 62), "b")
                ids.append(vec_id)
                packed.append(whole.astype("<i8").tobytes())
        return {"vec_id": ids, "v": packed}

    return in_arrow(rows.select(F.col("vec_id").cast("long"), "embedding"), work,
                    "vec_id long, v binary")


def stack(packed: pd.Series) -> np.ndarray:
    rows = [np.frombuffer(x, "<i8") for x in packed]
    out = np.zeros((len(rows), max(map(len, rows), default=0)), dtype=np.int64)
    for k, row in enumerate(rows):
        out[k, :len(row)] = row
    return out


def narrow(values: np.ndarray) -> np.ndarray:
    top = int(np.abs(values).max(initial=0))
    return values.astype(next(t for t in ("i1", "i2", "i4", "i8") if top <= np.iinfo(t).max))


def exact_kind(q: np.ndarray, v: np.ndarray):
    """Floating point while every inner product fits its mantissa, else longs."""
    most = float(np.abs(q.astype(np.float64)).max(initial=0)) * float(
        np.abs(v.astype(np.float64)).max(initial=0)) * max(q.shape[1], 1)
    return np.float32 if most < 2 ** 24 else np.float64 if most < 2 ** 53 else np.int64


def products(q: np.ndarray, v: np.ndarray) -> np.ndarray:
    """Exact inner products of all queries and vectors."""
    kind = exact_kind(q, v)
    return (q.astype(kind) @ v.astype(kind).T).astype(np.int64)


def blocks(rows: DataFrame, block: str, extra: str | None, width: int) -> DataFrame:
    """Rows (cid, v) of each block as one row per score list: ids and packed components."""
    edges = np.linspace(0, width, LISTS + 1).astype(int).tolist()

    def pack(rows: pd.DataFrame) -> pd.DataFrame:
        values = np.zeros((len(rows), width), dtype=np.int64)
        found = stack(rows["v"])
        values[:, :found.shape[1]] = found
        out = []
        for k in range(LISTS):
            part = narrow(values[:, edges[k]:edges[k + 1]])
            out.append({
                "list": k, block: rows[block].iloc[0], "cids": rows["cid"].to_numpy("<i8").tobytes(),
                "cut": rows[extra].to_numpy("<i8").tobytes() if extra else b"",
                "kind": part.dtype.str, "part": part.tobytes()})
        return pd.DataFrame(out)

    return rows.groupBy(block).applyInPandas(
        pack, f"list int, {block} long, cids binary, cut binary, kind string, part binary")


def unpack(row) -> tuple[np.ndarray, np.ndarray]:
    ids = np.frombuffer(row["cids"], "<i8")
    return ids, np.frombuffer(row["part"], row["kind"]).reshape(len(ids), -1)


PAIRS = "list int, qid long, cid long, s long"
BLOCK = "list int, vb long, qb long, role string, cids binary, cut binary, kind string, part binary"


def meet(vectors: DataFrame, queries: DataFrame, n_vb: int, n_qb: int, work, schema: str,
         entries: DataFrame | None = None) -> DataFrame:
    """Every vector block with every query block of its list, a pair a task, and what was
    sent to that pair. work(list, vb, qb, v, q, e) gets the rows, e is None without entries.
    """
    def every(n):
        return F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long")))

    names = [c.split()[0] for c in BLOCK.split(", ")]
    both = (vectors.withColumns({"qb": every(n_qb), "role": F.lit("v")}).select(*names)
            .unionAll(queries.withColumns({"vb": every(n_vb), "role": F.lit("q")}).select(*names)))
    sent = entries is not None
    if sent:
        both = both.unionAll(entries.select(*names))

    columns = [c.split()[0] for c in schema.split(", ")]

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        role = {r: part.iloc[0] for r, part in rows.groupby("role")}
        if "v" not in role or "q" not in role or (sent and "e" not in role):
            return pd.DataFrame({c: [] for c in columns})
        first = rows.iloc[0]
        return work(int(first["list"]), int(first["vb"]), int(first["qb"]),
                    role["v"], role["q"], role.get("e"))

    return both.groupBy("list", "vb", "qb").applyInPandas(run, schema)


def gather(k: int):
    """Phase one: each query's best local scores in the block."""
    def work(which, vb, qb, v_row, q_row, _):
        cids, v = unpack(v_row)
        qids, q = unpack(q_row)
        few, found = min(k, len(cids)), []
        for start in range(0, len(qids), 256):
            s = products(q[start:start + 256], v)
            j = np.argpartition(-s, few - 1, axis=1)[:, :few]
            i = np.arange(len(s))[:, None]
            found.append((np.repeat(qids[start:start + 256], few), cids[j.ravel()], s[i, j].ravel()))
        qid, cid, score = (np.concatenate(x) for x in zip(*found))
        return pd.DataFrame({"list": np.full(len(qid), which, "int32"), "qid": qid, "cid": cid, "s": score})
    return work


def collect(which, vb, qb, v_row, q_row, _):
    """Phase two: all entries with half the cutoff or more, packed, bound for the other list."""
    _, v = unpack(v_row)
    _, q = unpack(q_row)
    half = -(-np.frombuffer(q_row["cut"], "<i8") // LISTS)
    found = [(np.empty(0, np.int32), np.empty(0, np.int32), np.empty(0, np.int64))]
    for start in range(0, len(q), 256):
        s = products(q[start:start + 256], v)
        i, j = np.nonzero(s >= half[start:start + 256, None])
        found.append(((i + start).astype("<i4"), j.astype("<i4"), s[i, j]))
    i, j, s = (np.concatenate(x) for x in zip(*found))
    return pd.DataFrame([{
        "list": LISTS - 1 - which, "vb": vb, "qb": qb, "role": "e", "cids": i.astype("<i4").tobytes(),
        "cut": j.astype("<i4").tobytes(), "kind": "", "part": s.astype("<i8").tobytes()}])


def resolve(which, vb, qb, v_row, q_row, e_row):
    """Phase three: the rest of each entry's score from this list; what reaches the cutoff."""
    cids, v = unpack(v_row)
    qids, q = unpack(q_row)
    cut = np.frombuffer(q_row["cut"], "<i8")
    i, j = np.frombuffer(e_row["cids"], "<i4"), np.frombuffer(e_row["cut"], "<i4")
    score = np.frombuffer(e_row["part"], "<i8").copy()
    kind = exact_kind(q, v)
    q, v = q.astype(kind), v.astype(kind)
    for start in range(0, len(i), 1 << 16):
        some = slice(start, start + (1 << 16))
        score[some] += np.einsum("nd,nd->n", q[i[some]], v[j[some]]).astype(np.int64)
    good = score >= cut[i]
    return pd.DataFrame({"qid": qids[i[good]], "cid": cids[j[good]], "score": score[good]})


def resolved(pairs: DataFrame, classes: DataFrame) -> DataFrame:
    """Whole inner products of (qid, cid) pairs."""
    def work(batch):
        q, v = (batch.column(k).to_pylist() for k in ("qv", "v"))
        scores = []
        for a, b in zip(q, v):
            x, y = np.frombuffer(a, "<i8"), np.frombuffer(b, "<i8")
            n = min(len(x), len(y))
            scores.append(int(x[:n] @ y[:n]))
        return {"qid": batch.column("qid"), "cid": batch.column("cid"), "score": scores}

    vectors = classes.select("cid", "v")
    asked = classes.select(F.col("cid").alias("qid"), F.col("v").alias("qv"))
    return in_arrow(pairs.select("qid", "cid").join(vectors, "cid").join(asked, "qid"), work,
                    "qid long, cid long, score long")


def top_k(rows: DataFrame, is_query, k: int = 20) -> DataFrame:
    """query_id, rank, vec_id, score: each query id's k best other rows by inner product,
    ties to the smaller vec_id. is_query: condition on vec_id.
    """
    vectors = stored(quantised(rows).distinct(), "vectors")
    nth = F.row_number().over(Window.partitionBy("v").orderBy("vec_id"))
    members = (vectors.withColumn("n", nth).where(F.col("n") <= k + 1).groupBy("v")
               .agg(F.sort_array(F.collect_list("vec_id")).alias("ids")))
    asked = vectors.groupBy("v").agg(F.max(is_query).alias("asked"))
    classes = stored(members.join(asked, "v").withColumn(
        "cid", F.monotonically_increasing_id()), "classes")
    facts = classes.agg(F.count("*").alias("n"), F.sum(F.col("asked").cast("long")).alias("q"),
                        F.max(F.length("v") / 8).cast("int").alias("width")).first()
    n_vb, n_qb = -(-facts.n // VECTORS_IN_BLOCK) or 1, -(-(facts.q or 0) // QUERIES_IN_BLOCK) or 1
    width = max(facts.width or 0, LISTS)
    spread = lambda n: F.pmod(F.xxhash64("cid"), F.lit(n))
    by_block = stored(blocks(classes.withColumn("vb", spread(n_vb)), "vb", None, width), "blocks")
    queries = classes.where("asked").withColumn("qb", spread(n_qb))
    asked_blocks = blocks(queries.withColumn("none", F.lit(0)), "qb", "none", width)

    # As many of the best as may be the query's own leave again: all vectors under its id.
    most = (vectors.where(is_query).groupBy("vec_id").count().agg(F.max("count")).first()[0] or 0) + k
    heads = meet(by_block, asked_blocks, n_vb, n_qb, gather(most), PAIRS)
    place = F.row_number().over(Window.partitionBy("qid", "list").orderBy(F.desc("s"), "cid"))
    gathered = heads.withColumn("n", place).where(F.col("n") <= most).select("qid", "cid").distinct()
    nth_best = F.row_number().over(Window.partitionBy("qid").orderBy(F.desc("score"), "cid"))
    cutoffs = stored(resolved(gathered, classes).withColumn("n", nth_best)
                     .where(F.col("n") == most).select("qid", F.col("score").alias("cutoff")), "cutoffs")
    # With fewer candidates than that in all, everything is collected.
    safe = stored(blocks(
        queries.join(cutoffs, F.col("cid") == F.col("qid"), "left").select(
            "cid", "v", "qb", F.coalesce("cutoff", F.lit(-(1 << 62))).alias("cutoff")),
        "qb", "cutoff", width), "queries")
    sent = stored(meet(by_block, safe, n_vb, n_qb, collect, BLOCK), "entries")
    # A vector that both lists have sent is resolved by both, with one result.
    reached = meet(by_block, safe, n_vb, n_qb, resolve, "qid long, cid long, score long", sent).distinct()
    order = F.row_number().over(Window.partitionBy("qid").orderBy(F.desc("score"), "vec_id"))
    tops = (reached.join(classes.select("cid", "ids"), "cid")
            .select("qid", "score", F.explode("ids").alias("vec_id"))
            .withColumn("n", order).where(F.col("n") <= most).groupBy("qid")
            .agg(F.sort_array(F.collect_list(F.struct("n", "vec_id", "score"))).alias("best")))
    own = (vectors.where(is_query).join(classes.select("v", F.col("cid").alias("qid")), "v")
           .select(F.col("vec_id").alias("query_id"), "qid"))
    others = F.slice(F.filter("best", lambda x: x["vec_id"] != F.col("query_id")), 1, k)
    # Different vectors under one query id are one query: its best over all of them.
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return (own.join(tops, "qid").select("query_id", F.explode(others).alias("one"))
            .select("query_id", "one.vec_id", "one.score").withColumn("rank", rank)
            .where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score"))


def search_table(rows: DataFrame) -> DataFrame:
    return top_k(rows, F.expr("vec_id % 20 = 0"))


SQL = """
WITH good AS (
  SELECT vec_id, [floor(64 * x::DOUBLE)::BIGINT for x in embedding] AS v
  FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len([x for x in embedding if x IS NULL OR NOT isfinite(x::DOUBLE)]) = 0),
pairs AS (
  SELECT q.vec_id AS query_id, c.vec_id,
    list_inner_product(q.v::DOUBLE[], c.v::DOUBLE[])::BIGINT AS score
  FROM good q JOIN good c ON q.vec_id % 20 = 0 AND q.vec_id <> c.vec_id),
ranked AS (
  SELECT query_id, vec_id, score,
    row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank FROM pairs)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 20
"""
