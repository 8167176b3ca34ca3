"""Every operator on odd rows, on an empty table, and on rows in another order."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from orderlens.llm import (
    hmm, languages, licenses, minhash, mixing, packing, quality, repeats, simhash, spotsigs, topk,
)


def labels_of(docs):
    return docs.where("doc_id < 20").select(
        "doc_id", (F.col("doc_id") % 3 != 0).cast("int").alias("quality"), F.lit(0).alias("toxic")
    ).distinct()


OPERATORS = {
    "packing": packing.pack,
    "hmm": hmm.score_table,
    "repeats": repeats.repeats_table,
    "simhash": simhash.near_duplicates,
    "spotsigs": spotsigs.edits_table,
    "mixing": mixing.mix_table,
    "quality": lambda docs: quality.quality_table(docs, labels_of(docs)),
    "licenses": licenses.scan_licenses,
    "languages": languages.language_table,
    "minhash": minhash.near_duplicates,
}


def rows(frame):
    digits = [F.round(c, 9).alias(c) if t == "double" else F.col(c) for c, t in frame.dtypes]
    return sorted(map(repr, frame.select(digits).collect()))


@pytest.mark.parametrize("name", sorted(OPERATORS))
def test_odd_rows(name, odd):
    got = OPERATORS[name](odd)
    per_document = got.where("part = 0") if name == "packing" else got
    assert per_document.count() == odd.count()
    assert rows(got) == rows(OPERATORS[name](odd.select(*reversed(odd.columns)).repartition(5)))


@pytest.mark.parametrize("name", sorted(OPERATORS))
def test_empty_table(name, odd):
    assert OPERATORS[name](odd.where("false")).count() == 0


@pytest.mark.parametrize("name", sorted(OPERATORS))
def test_only_missing_texts(name, documents):
    docs = documents([(1, None), (2, None), (3, "")])
    assert OPERATORS[name](docs).count() == 3


def test_odd_vectors(spark):
    nan, inf = float("nan"), float("inf")
    data = [(0, [1.0, 2.0]), (0, [1.0, 2.0]), (1, None), (2, [None, 1.0]), (3, [nan, 1.0]),
            (4, [inf, 1.0]), (None, [1.0, 1.0]), (20, []), (21, [3.0]), (22, [1.0, 2.0, 3.0])]
    table = spark.createDataFrame(data, "vec_id long, embedding array<float>").withColumn("v", F.lit(1))
    got = {(r.query_id, r.rank): (r.vec_id, r.score) for r in topk.search_table(table).collect()}
    assert got == {(0, 1): (22, 5 * 4096), (0, 2): (21, 3 * 4096), (0, 3): (20, 0),
                   (20, 1): (0, 0), (20, 2): (21, 0), (20, 3): (22, 0)}
    assert topk.search_table(table.where("false")).count() == 0


@pytest.mark.parametrize("name", [name for name, _ in corpus_pipeline.STAGES])
def test_stages_on_odd_rows(spark, odd, tmp_path, name):
    labels_of(odd).write.parquet(f"{tmp_path}/labels.parquet")
    stage = dict(corpus_pipeline.STAGES)[name]
    last = name == corpus_pipeline.STAGES[-1][0]
    for docs in (odd, odd.where("false")):
        got = stage(spark, docs, str(tmp_path))
        assert last or got.columns == docs.columns
        assert got.count() <= 3 * docs.count() or last
