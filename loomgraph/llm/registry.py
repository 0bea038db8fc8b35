"""The queries of this subpackage, for the driver."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from loomgraph.llm import conversation_repair, html_extract, language_id, lm_scoring, media_columns, mixing, packing, periodic_runs, quality_rules, simhash, substring_dedup, url_filter, warc


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_best_fit_packing": packing.op1,
        "op2_lm_scoring": lm_scoring.op2,
        "op3_media_columns": media_columns.op3,
        "op4_language_id": language_id.op4,
        "op5_substring_dedup": substring_dedup.op5,
        "op6_warc": warc.op6,
        "op7_quality_rules": quality_rules.op7,
        "op8_html_extraction": html_extract.op8,
        "op9_simhash": simhash.op9,
        "op10_mixing": mixing.op10,
        "op11_url_filters": url_filter.op11,
        "op12_periodic_runs": periodic_runs.op12,
        "op13_conversation_repair": conversation_repair.op13,
        "quality_ablations": quality_rules.ablation_report,
    }


def oracle_sql() -> dict[str, str]:
    """Only where SQL can express the method."""
    return {"op5_substring_dedup": substring_dedup.OP5_SQL, "op6_warc": warc.OP6_SQL, "op7_quality_rules": quality_rules.OP7_SQL, "op11_url_filters": url_filter.OP11_SQL, "quality_ablations": quality_rules.ABLATIONS_SQL}
