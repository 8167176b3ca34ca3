"""The registered queries of this subpackage, and the SQL of those SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from orderlens.llm import (
    hmm, languages, licenses, minhash, mixing, negatives, packing, prefixes, quality, repeats,
    simhash, spotsigs, topk,
)
from orderlens.llm.common import small_batches, table


def bound(build: Callable[..., DataFrame], *names: str):
    """A query that hands the named tables to an operator."""
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        small_batches(spark)
        return build(*[table(spark, sf_dir, name) for name in names])
    return run


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_packing": bound(packing.pack, "documents"),
    "op2_hmm": bound(hmm.score_table, "documents"),
    "op3_topk": bound(topk.search_table, "embeddings"),
    "op4_repeats": bound(repeats.repeats_table, "documents"),
    "op5_simhash": bound(simhash.near_duplicates, "documents"),
    "op6_spotsigs": bound(spotsigs.edits_table, "documents"),
    "op7_mixing": bound(mixing.mix_table, "documents"),
    "op8_quality": bound(quality.quality_table, "documents", "labels"),
    "op9_licenses": bound(licenses.scan_licenses, "documents"),
    "op10_languages": bound(languages.language_table, "documents"),
    "op11_superminhash": bound(minhash.near_duplicates, "documents"),
    "op12_prefix_trie": bound(prefixes.trie_table, "conversations"),
    "op13_hard_negatives": bound(negatives.mine_table, "embeddings"),
}

SQL = {"op3_topk": topk.SQL, "op7_mixing": mixing.SQL, "op12_prefix_trie": prefixes.SQL,
       "op13_hard_negatives": negatives.SQL}
