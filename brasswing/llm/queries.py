"""The operators' queries over the document tables, by name, and the SQL that checks those SQL can express."""

from __future__ import annotations

from brasswing.llm import decontamination, language, near_duplicates, personal_data, quality, secrets, token_shards, unigram, warc

_QUERIES = {
    "op1_decontamination": decontamination.op1_decontamination,
    "op2_secret_scan": secrets.op2_secret_scan,
    "op3_near_duplicates": near_duplicates.op3_near_duplicates,
    "op4_token_counts": unigram.op4_token_counts,
    "op5_personal_data": personal_data.op5_personal_data,
    "op6_language": language.op6_language,
    "op7_token_shards": token_shards.op7_token_shards,
    "op8_warc": warc.op8_warc,
    "op9_sentencepiece": unigram.op9_sentencepiece,
    "op10_quality_rules": quality.op10_quality_rules,
}
_ORACLES = {"op3_near_duplicates": near_duplicates.OP3_SQL.strip(), "op8_warc": warc.OP8_SQL.strip()}


def queries():
    return dict(_QUERIES)


def oracle_sql():
    return dict(_ORACLES)
