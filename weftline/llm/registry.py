"""The queries of this subpackage."""

from __future__ import annotations

import corpus_pipeline
from weftline.llm import align, ann, decontaminate, langid, lattice, lm, maintext, manifest, secrets, setjoin, sharding, tokens, warc

QUERIES = {
    "op1_one_bit_codes": ann.op1_one_bit_codes,
    "op2_language_id": langid.op2_language_id,
    "op3_credential_linking": secrets.op3_credential_linking,
    "op4_deleted_interpolation": lm.op4_deleted_interpolation,
    "op5_gumbel_segmentation": lattice.op5_gumbel_segmentation,
    "op6_set_relation_join": setjoin.op6_set_relation_join,
    "op7_warc_round_trip": warc.op7_warc_round_trip,
    "op8_positional_index": decontaminate.op8_positional_index,
    "op9_jump_sharding": sharding.op9_jump_sharding,
    "op10_wavelet_shards": tokens.op10_wavelet_shards,
    "op11_token_alignment": align.op11_token_alignment,
    "op12_radix_manifest": manifest.op12_radix_manifest,
    "op13_main_text": maintext.op13_main_text,
    "pipeline": corpus_pipeline.run,
}
ORACLES = {
    "op3_credential_linking": secrets.ORACLE,
    "op6_set_relation_join": setjoin.ORACLE,
    "op7_warc_round_trip": warc.ORACLE,
    "op8_positional_index": decontaminate.ORACLE,
    "op9_jump_sharding": sharding.ORACLE,
    "op12_radix_manifest": manifest.ORACLE,
}
