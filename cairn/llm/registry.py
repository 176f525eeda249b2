"""This package's queries and, where SQL can express them, their SQL."""

from __future__ import annotations

from cairn.llm import edit_fingerprint, exact_duplicates, language_id, mixing, near_duplicates, packing, secrets, token_output, toxicity, warc

QUERIES = {
    "op1_mixing": mixing.mixing_query,
    "op2_language_id": language_id.language_id_query,
    "op3_secrets": secrets.secrets_query,
    "op4_near_duplicates": near_duplicates.near_duplicates_query,
    "op5_packing": packing.packing_query,
    "op6_token_output": token_output.token_output_query,
    "op7_toxicity": toxicity.toxicity_query,
    "op8_edit_fingerprint": edit_fingerprint.edit_fingerprint_query,
    "op9_warc": warc.warc_query,
    "op10_exact_duplicates": exact_duplicates.exact_duplicates_query,
}

SQL = {
    "op3_secrets": secrets.SECRETS_SQL,
    "op9_warc": warc.WARC_SQL,
    "op10_exact_duplicates": exact_duplicates.EXACT_DUPLICATES_SQL,
}


def pipeline(spark, sf_dir: str):
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES["pipeline"] = pipeline
