"""Queries of the corpus operators over their whole tables, and the SQL for those that SQL can express.

The others are tested against brute force, round trips or held-out accuracy in tests/llm.
"""

from __future__ import annotations

from webloom.llm import (
    ann,
    bpe,
    decontaminate,
    fill_middle,
    jaccard,
    langid,
    line_dedup,
    line_quality,
    pii,
    pitman_yor,
    ranked_search,
    sharding,
    toxicity,
)

QUERIES = {
    "op1_pii": pii.op1_pii,
    "op2_line_dedup": line_dedup.op2_line_dedup,
    "op3_decontaminate": decontaminate.op3_decontaminate,
    "op4_jaccard_join": jaccard.op4_jaccard_join,
    "op5_ann": ann.op5_ann,
    "op6_shards": sharding.op6_shards,
    "op7_langid": langid.op7_langid,
    "op8_pitman_yor": pitman_yor.op8_pitman_yor,
    "op9_toxicity": toxicity.op9_toxicity,
    "op10_bpe": bpe.op10_bpe,
    "op11_ranked_search": ranked_search.op11_ranked_search,
    "op12_fill_middle": fill_middle.op12_fill_middle,
    "op13_line_quality": line_quality.op13_line_quality,
}

ORACLES = {
    "op2_line_dedup": line_dedup.SQL,
    "op4_jaccard_join": jaccard.SQL,
    "op11_ranked_search": ranked_search.SQL,
    "op12_fill_middle": fill_middle.SQL,
}
