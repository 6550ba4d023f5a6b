"""The operators' queries and DuckDB SQL."""

from __future__ import annotations

from . import bpe, chat, decontamination, jaccard, language, mixing, periodic, pii, sharding, spelling, token_counts, toxicity, vectors


def queries():
    return {
        "op10_vectors": vectors.op10_vectors,
        "op11_spelling": spelling.op11_spelling,
        "op12_mixing": mixing.op12_mixing,
        "op13_periodic_runs": periodic.op13_periodic_runs,
        "op1_decontamination": decontamination.op1_decontamination,
        "op2_bpe": bpe.op2_bpe,
        "op3_token_counts": token_counts.op3_token_counts,
        "op4_jaccard": jaccard.op4_jaccard,
        "op5_language": language.op5_language,
        "op6_toxicity": toxicity.op6_toxicity,
        "op7_chat": chat.op7_chat,
        "op8_pii": pii.op8_pii,
        "op9_sharding": sharding.op9_sharding,
    }


def oracle_sql():
    return {"op1_decontamination": decontamination.SQL, "op10_vectors": vectors.SQL, "op11_spelling": spelling.SQL, "op12_mixing": mixing.SQL, "op13_periodic_runs": periodic.SQL, "op4_jaccard": jaccard.SQL, "op7_chat": chat.SQL, "op9_sharding": sharding.sql()}
