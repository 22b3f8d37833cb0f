"""The subpackage's queries and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import chat, decontaminate, exact, mixing, negatives, pii, quality, simhash, spelling, tokencount, tokenfile, toxicity, urls


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_pii": pii.query,
        "op2_quality": quality.query,
        "op3_url_filters": urls.query,
        "op4_token_counts": tokencount.query,
        "op5_token_files": tokenfile.query,
        "op6_simhash": simhash.query,
        "op7_toxicity": toxicity.query,
        "op8_chat": chat.query,
        "op9_mixing": mixing.query,
        "op10_decontaminate": decontaminate.query,
        "op11_spelling": spelling.query,
        "op12_hard_negatives": negatives.query,
        "op13_exact_dedup": exact.query,
    }


def oracle_sql() -> dict[str, str]:
    return {"op8_chat": chat.SQL, "op9_mixing": mixing.SQL, "op11_spelling": spelling.SQL, "op12_hard_negatives": negatives.SQL, "op13_exact_dedup": exact.SQL}
