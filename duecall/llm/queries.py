"""The queries of the corpus operators, opN_<name>, and the SQL of those that SQL can express."""

from __future__ import annotations

import corpus_pipeline
from duecall.llm import bpe, chat, decontamination, divergence, licenses, line_dedup, media, mixing, near_dup, pii, quality, vector_codes, warc


def queries() -> dict:
    return {"op1_line_dedup": line_dedup.query, "op2_bpe": bpe.query, "op3_warc": warc.query, "op4_pii": pii.query, "op5_mixing": mixing.query, "op6_chat_formatting": chat.query, "op7_near_dup": near_dup.query, "op8_media_columns": media.query, "op9_license_scans": licenses.query, "op10_quality_rules": quality.query, "op11_vector_codes": vector_codes.query, "op12_decontamination": decontamination.query, "op13_divergence": divergence.query, "pipeline": corpus_pipeline.run}


def oracle_sql() -> dict:
    return {"op3_warc": warc.ORACLE, "op5_mixing": mixing.ORACLE, "op6_chat_formatting": chat.ORACLE, "op7_near_dup": near_dup.ORACLE, "op9_license_scans": licenses.oracle(), "op10_quality_rules": quality.ORACLE, "op11_vector_codes": vector_codes.oracle(), "op12_decontamination": decontamination.ORACLE, "op13_divergence": divergence.ORACLE}
