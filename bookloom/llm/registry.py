"""Queries of this subpackage and the SQL that gives the same rows."""

from __future__ import annotations

from bookloom.llm import chat_format, divergence, exact_dedup, lang_id, licenses, line_dedup, media, mixing, ngram_join, packing, quality, spelling, warc


def queries() -> dict:
    import corpus_pipeline

    return {
        "pipeline": corpus_pipeline.run,
        "op1_mixing": mixing.op1_mixing,
        "op2_packing": packing.op2_packing,
        "op3_line_dedup": line_dedup.op3_line_dedup,
        "op4_licenses": licenses.op4_licenses,
        "op5_media": media.op5_media,
        "op6_lang_id": lang_id.op6_lang_id,
        "op7_ngram_join": ngram_join.op7_ngram_join,
        "op8_chat_format": chat_format.op8_chat_format,
        "op9_quality": quality.op9_quality,
        "op10_warc": warc.op10_warc,
        "op11_spelling": spelling.op11_spelling,
        "op12_exact_dedup": exact_dedup.op12_exact_dedup,
        "op13_divergence": divergence.op13_divergence,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op3_line_dedup": line_dedup.OP3_SQL,
        "op8_chat_format": chat_format.OP8_SQL,
        "op10_warc": warc.OP10_SQL,
        "op12_exact_dedup": exact_dedup.OP12_SQL,
        "op13_divergence": divergence.OP13_SQL,
    }
