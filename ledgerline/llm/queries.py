"""The queries of this subpackage and their SQL."""

from __future__ import annotations

import corpus_pipeline

from . import chat, dedup, license_scan, media, mixing, negatives, packing, pii, quality, sharding, toxicity, trie, warc

QUERIES = {
    "op1_quality": quality.op1_quality,
    "op2_toxicity": toxicity.op2_toxicity,
    "op3_warc": warc.op3_warc,
    "op4_sharding": sharding.op4_sharding,
    "op5_license_scan": license_scan.op5_license_scan,
    "op6_mixing": mixing.op6_mixing,
    "op7_packing": packing.op7_packing,
    "op8_media": media.op8_media,
    "op9_pii": pii.op9_pii,
    "op10_near_dedup": dedup.op10_near_dedup,
    "op11_chat": chat.op11_chat,
    "op12_prefix_trie": trie.op12_prefix_trie,
    "op13_hard_negatives": negatives.op13_hard_negatives,
    "pipeline": corpus_pipeline.run,
}


def oracle_sql() -> dict[str, str]:
    """Tagging, alignment, tokenizers and images are beyond SQL; their queries are tested by brute force."""
    found = {
        "op1_quality": quality.SQL,
        "op3_warc": warc.SQL,
        "op4_sharding": sharding.sql(),
        "op6_mixing": mixing.SQL,
        "op11_chat": chat.SQL,
        "op12_prefix_trie": trie.SQL,
        "op13_hard_negatives": negatives.SQL,
        "pipeline": corpus_pipeline.ORACLE_SQL,
    }
    return {name: sql for name, sql in found.items() if sql}
