"""The registered queries of the training-data operators and their DuckDB SQL."""

from __future__ import annotations

from tidemark.llm import bagminhash, decontaminate, packing, pieces, quality, recompress, search, secrets, sharding, toxicity, variants, warc, winnow

QUERIES = {
    "op7_pieces": pieces.op7_pieces,
    "op1_toxicity": toxicity.op1_toxicity,
    "op8_fingerprints": winnow.op8_fingerprints,
    "op9_near": bagminhash.op9_near,
    "op2_substring": recompress.op2_substring,
    "op3_packing": packing.op3_packing,
    "op4_secrets": secrets.op4_secrets,
    "op5_warc": warc.op5_warc,
    "op6_sharding": sharding.op6_sharding,
    "op10_quality": quality.op10_quality,
    "op11_variants": variants.op11_variants,
    "op12_search": search.op12_search,
    "op13_decontamination": decontaminate.op13_decontamination,
}
ORACLE_SQL = {
    "op2_substring": recompress.OP2_SQL,
    "op5_warc": warc.OP5_SQL,
    "op10_quality": quality.OP10_SQL,
    "op11_variants": variants.OP11_SQL,
    "op12_search": search.OP12_SQL,
    "op13_decontamination": decontaminate.OP13_SQL,
}
