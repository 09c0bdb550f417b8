"""Queries of this subpackage and their SQL, by name."""

from __future__ import annotations

from . import bpe, conversations, exact_dedup, fill_middle, fingerprints, licenses, mixing, ngram_join, pieces, quality, repeats, toxicity, warc
from .scratch import workers_import

_OPERATORS = {
    "op1_warc": warc.op1_warc,
    "op2_ngram_join": ngram_join.op2_ngram_join,
    "op3_exact_dedup": exact_dedup.op3_exact_dedup,
    "op4_suffix_dedup": repeats.op4_suffix_dedup,
    "op5_bpe": bpe.op5_bpe,
    "op6_fingerprints": fingerprints.op6_fingerprints,
    "op7_toxicity": toxicity.op7_toxicity,
    "op8_quality": quality.op8_quality,
    "op9_license_scan": licenses.op9_license_scan,
    "op10_mix_sources": mixing.op10_mix_sources,
    "op11_conversation_repair": conversations.op11_conversation_repair,
    "op12_fill_middle": fill_middle.op12_fill_middle,
    "op13_sentencepiece": pieces.op13_sentencepiece,
}


def _query(operator):
    def query(spark, sf_dir):
        workers_import(spark)
        return operator(spark, sf_dir)

    return query


QUERIES = {name: _query(operator) for name, operator in _OPERATORS.items()}
ORACLE_SQL = {"op1_warc": warc.SQL, "op4_suffix_dedup": repeats.SQL, "op2_ngram_join": ngram_join.SQL, "op3_exact_dedup": exact_dedup.SQL, "op9_license_scan": licenses.SQL, "op10_mix_sources": mixing.SQL, "op11_conversation_repair": conversations.SQL, "op12_fill_middle": fill_middle.SQL}
