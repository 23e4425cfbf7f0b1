"""The subpackage's queries and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from strandline.llm.language import op3_language_families
from strandline.llm.line_dedup import OP2_SQL, op2_line_dedup
from strandline.llm.mixing import OP8_SQL, op8_source_mixing
from strandline.llm.near_dup import OP4_SQL, op4_near_duplicates
from strandline.llm.packing import op10_best_fit_packing
from strandline.llm.quality import OP7_SQL, op7_weak_supervision_quality
from strandline.llm.repeats import OP6_SQL, op6_suffix_array_repeats
from strandline.llm.surrogates import op1_pii_surrogates
from strandline.llm.toxicity import op9_toxicity_ftrl
from strandline.llm.vectors import OP5_SQL, op5_cover_tree_links

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_pii_surrogates": op1_pii_surrogates,
    "op2_line_dedup": op2_line_dedup,
    "op3_language_families": op3_language_families,
    "op4_near_duplicates": op4_near_duplicates,
    "op5_cover_tree_links": op5_cover_tree_links,
    "op6_suffix_array_repeats": op6_suffix_array_repeats,
    "op7_weak_supervision_quality": op7_weak_supervision_quality,
    "op8_source_mixing": op8_source_mixing,
    "op9_toxicity_ftrl": op9_toxicity_ftrl,
    "op10_best_fit_packing": op10_best_fit_packing,
}

ORACLE_SQL: dict[str, str] = {
    "op2_line_dedup": OP2_SQL,
    "op4_near_duplicates": OP4_SQL,
    "op5_cover_tree_links": OP5_SQL,
    "op6_suffix_array_repeats": OP6_SQL,
    "op7_weak_supervision_quality": OP7_SQL,
    "op8_source_mixing": OP8_SQL,
}
