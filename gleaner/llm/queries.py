"""The queries of this package and their DuckDB equivalents, where SQL can express one."""

from __future__ import annotations

from . import byte_bpe, cnn, decontaminate, jaccard_join, licenses, merkle, neural_lm, prefix_trie, quality_rules, secrets, sharding, token_file, warc
from .common import table
from .oracles import oracle_sql  # noqa: F401  part of this module's interface


def queries():
    return {
        "op1_byte_bpe": lambda spark, d: byte_bpe.digests(table(spark, d, "documents")),
        "op2_quality_rules": lambda spark, d: quality_rules.digests(table(spark, d, "documents")),
        "op3_token_file": lambda spark, d: token_file.digests(table(spark, d, "documents")),
        "op4_jaccard_join": lambda spark, d: jaccard_join.digests(table(spark, d, "documents")),
        "op5_decontaminate": lambda spark, d: decontaminate.digests(table(spark, d, "documents"), table(spark, d, "benchmark")),
        "op6_warc": lambda spark, d: warc.digests(table(spark, d, "pages")),
        "op7_licenses": lambda spark, d: licenses.digests(table(spark, d, "documents")),
        "op8_secrets": lambda spark, d: secrets.digests(table(spark, d, "documents")),
        "op9_neural_lm": lambda spark, d: neural_lm.digests(table(spark, d, "documents")),
        # The base columns alone, which SQL can express.
        "llm_base_quality_rules": lambda spark, d: quality_rules.digests(table(spark, d, "documents")).drop("kept", "probability"),
        "llm_base_licenses": lambda spark, d: licenses.digests(table(spark, d, "documents")).drop("labels", "score"),
        "op10_cnn": lambda spark, d: cnn.digests(table(spark, d, "documents"), table(spark, d, "labels")),
        "op11_merkle": lambda spark, d: merkle.digests(table(spark, d, "documents")),
        "op12_sharding": lambda spark, d: sharding.digests(table(spark, d, "documents")),
        "op13_prefix_trie": lambda spark, d: prefix_trie.digests(table(spark, d, "conversations")),
    }

