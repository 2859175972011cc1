"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

from loopwise.llm import centroids, chat, decontam, langid, lattice_lm, media, merkle, mixing, neardup, pii, quality, token_files, toxicity

QUERIES = {
    "op1_source_mix": mixing.op1,
    "op2_chroma_fingerprints": media.op2,
    "op3_pseudonyms": pii.op3,
    "op4_quality": quality.op4,
    "op5_toxicity": toxicity.op5,
    "op6_token_files": token_files.op6,
    "op7_chat_format": chat.op7,
    "op8_decontamination": decontam.op8,
    "op9_near_duplicates": neardup.op9,
    "op10_language": langid.op10,
    "op11_merkle_manifest": merkle.op11,
    "op12_delta_lloyd": centroids.op12,
    "op13_lattice_likelihood": lattice_lm.op13,
}
ORACLES = {"op7_chat_format": chat.ORACLE, "op8_decontamination": decontam.ORACLE, "op9_near_duplicates": neardup.ORACLE, "op11_merkle_manifest": merkle.ORACLE, "op12_delta_lloyd": centroids.ORACLE}
