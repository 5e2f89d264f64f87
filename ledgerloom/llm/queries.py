"""Registered queries of the operators: each over its whole table, production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ledgerloom.llm import (
    class_lm,
    conversation_trie,
    language,
    main_text,
    merkle,
    mixing,
    neighbours,
    packing,
    pii,
    quality,
    simhash,
    sql,
    substrings,
    token_files,
)
from ledgerloom.llm.common import table


def _over(name: str, operator: Callable[[DataFrame], DataFrame]):
    return lambda spark, folder: operator(table(spark, folder, name))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_pii": _over("documents", pii.digest),
    "op2_substring_dedup": _over("documents", substrings.digest),
    "op3_simhash": _over("documents", simhash.digest),
    "op4_mixing": _over("documents", mixing.digest),
    "op5_quality": _over("documents", quality.digest),
    "op6_token_files": _over("documents", lambda d: token_files.digest(token_files.write(d))),
    "op7_neighbours": _over("embeddings", neighbours.search),
    "op8_class_lm": _over("documents", class_lm.score_all),
    "op9_packing": _over("documents", packing.pack),
    "op10_language": _over("documents", language.identify),
    "op11_main_text": _over("pages", main_text.digest),
    "op12_conversation_trie": _over("conversations", conversation_trie.digest),
    "op13_merkle": _over("documents", merkle.digest),
}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return sql.statements()
