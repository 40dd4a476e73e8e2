"""The training-data queries and their DuckDB SQL."""

from __future__ import annotations

import corpus_pipeline
from quillmesh.llm import boundedmeans, contentsort, dartminhash, fmindex, personal, pieces, png, secrets, substrings, templates, tokenfiles, tokenlinks, toxicity


def queries():
    return {
        "op1_toxicity": toxicity.op1_toxicity,
        "op2_personal": personal.op2_personal,
        "op3_main_text": templates.op3_main_text,
        "op4_substrings": substrings.op4_substrings,
        "op5_dart_minhash": dartminhash.op5_dart_minhash,
        "op6_fm_index": fmindex.op6_fm_index,
        "op7_png": png.op7_png,
        "op8_secrets": secrets.op8_secrets,
        "op9_token_files": tokenfiles.op9_token_files,
        "op10_pieces": pieces.op10_pieces,
        "op11_content_sort": contentsort.op11_content_sort,
        "op12_bounded_means": boundedmeans.op12_bounded_means,
        "op13_token_links": tokenlinks.op13_token_links,
        "pipeline": corpus_pipeline.run,
    }


def oracle_sql():
    found = {} if corpus_pipeline.ORACLE_SQL is None else {"pipeline": corpus_pipeline.ORACLE_SQL}
    return found | {
        "op4_substrings": substrings.OP4_ORACLE,
        "op6_fm_index": fmindex.OP6_ORACLE,
        "op8_secrets": secrets.OP8_ORACLE,
        "op11_content_sort": contentsort.OP11_ORACLE,
        "op12_bounded_means": boundedmeans.OP12_ORACLE,
    }
