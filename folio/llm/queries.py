"""The queries of this subpackage, and SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from folio.llm.decontaminate import op6_decontamination, op6_sql
from folio.llm.jaccard_join import op1_ngram_jaccard_join, op1_sql
from folio.llm.langid import op2_language_id
from folio.llm.line_dedup import op7_line_dedup
from folio.llm.mixing import op5_source_mixing
from folio.llm.pii import op3_pii_surrogates
from folio.llm.sharding import op10_sharding
from folio.llm.syncmers import op8_syncmer_fingerprints
from folio.llm.tokens import op9_token_counts
from folio.llm.toxicity import op4_toxicity

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_ngram_jaccard_join": op1_ngram_jaccard_join,
    "op2_language_id": op2_language_id,
    "op3_pii_surrogates": op3_pii_surrogates,
    "op4_toxicity": op4_toxicity,
    "op5_source_mixing": op5_source_mixing,
    "op6_decontamination": op6_decontamination,
    "op7_line_dedup": op7_line_dedup,
    "op8_syncmer_fingerprints": op8_syncmer_fingerprints,
    "op9_token_counts": op9_token_counts,
    "op10_sharding": op10_sharding,
}

SQL: dict[str, str] = {"op1_ngram_jaccard_join": op1_sql(), "op6_decontamination": op6_sql()}
