"""The driver queries of the operators, their SQL where SQL can express them, and the pipeline."""

from __future__ import annotations

import corpus_pipeline

from . import bpe, chat, exact_dedup, fingerprint, licenses, minhash, packing, quality, suffix_dedup, toxicity


def queries():
    return {
        "op1_minhash_dedup": minhash.query,
        "op2_byte_bpe": bpe.query,
        "op3_quality": quality.query,
        "op4_suffix_dedup": suffix_dedup.query,
        "op5_packing": packing.query,
        "op6_exact_dedup": exact_dedup.query,
        "op7_fingerprints": fingerprint.query,
        "op8_licenses": licenses.query,
        "op9_chat_format": chat.query,
        "op10_toxicity": toxicity.query,
        "pipeline": corpus_pipeline.run,
    }


def oracle_sql():
    out = {"op6_exact_dedup": exact_dedup.ORACLE, "op8_licenses": licenses.ORACLE}
    return out | ({"pipeline": corpus_pipeline.ORACLE_SQL} if corpus_pipeline.ORACLE_SQL else {})
