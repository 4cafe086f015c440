"""The registered queries of the corpus operators: each applies one operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from logweave.llm import chat, decontaminate, fixity, jaccard, language, licences, nearest, packing, pages, prefixes, recipes, repair, toxicity

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_nearest_neighbours": nearest.query,
    "op2_mixture_packing": packing.query,
    "op3_ngram_jaccard_join": jaccard.query,
    "op4_toxicity": toxicity.query,
    "op5_decontamination": decontaminate.query,
    "op6_chat_formatting": chat.query,
    "op7_language_id": language.query,
    "op8_warc_fixity": fixity.query,
    "op9_licence_scan": licences.query,
    "op10_html_extraction": pages.query,
    "op11_structure_repair": repair.query,
    "op12_prefix_trie": prefixes.query,
    "op13_exact_dedup": recipes.query,
}

ORACLE_SQL: dict[str, str] = {
    "op3_ngram_jaccard_join": jaccard.ORACLE,
    "op5_decontamination": decontaminate.ORACLE,
    "op6_chat_formatting": chat.ORACLE,
    "op8_warc_fixity": fixity.ORACLE,
    "op9_licence_scan": licences.oracle(),
    "op11_structure_repair": repair.ORACLE,
    "op12_prefix_trie": prefixes.ORACLE,
    "op13_exact_dedup": recipes.ORACLE,
}
