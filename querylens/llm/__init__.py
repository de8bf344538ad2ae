"""Operations for large training-data pipelines. Nothing else in the library imports this subpackage."""

from __future__ import annotations


def queries():
    from . import chat_format, embedding_dedup, media_chunks, minhash_dedup, mixing, packing, secret_index, token_files, toxicity_fm, url_templates

    return {
        "op1_media_chunks": media_chunks.op1_media_chunks,
        "op2_url_templates": url_templates.op2_url_templates,
        "op3_packing": packing.op3_packing,
        "op4_embedding_dedup": embedding_dedup.op4_embedding_dedup,
        "op5_mixing": mixing.op5_mixing,
        "op6_secret_index": secret_index.op6_secret_index,
        "op7_chat_format": chat_format.op7_chat_format,
        "op8_token_files": token_files.op8_token_files,
        "op9_toxicity": toxicity_fm.op9_toxicity,
        "op10_minhash_dedup": minhash_dedup.op10_minhash_dedup,
    }


def oracle_sql():
    from . import mixing, sql

    return {"op4_embedding_dedup": sql.OP4, "op5_mixing": mixing.OP5_SQL, "op7_chat_format": sql.OP7, "op10_minhash_dedup": sql.OP10}
