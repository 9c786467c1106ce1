"""Registry of the engine's queries over the test tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import oracles, queries

NAMES = (
    "line_section_counts", "separator_profile", "ordered_distinct_tokens", "sentinel_coalesce", "amount_mentions", "url_normalise", "html_titles", "fetched_page_status",
    "query_variants", "quality_score", "penalty_score", "keyword_cut", "anti_fill_others", "line_islands", "gap_threshold", "top_line_per_document", "merge_by_conversation",
    "match_rates", "exact_matches", "fuzzy_matches", "section_walk", "sectioned_documents", "line_clusters", "word_boxes", "box_overlaps", "suppressed_boxes",
    "two_source_merge", "override_merge", "lenient_json", "catalogue_items", "request_images", "inline_segments", "payload_projection", "matching_keys", "line_keys",
    "glyph_texts", "distinct_variants", "list_texts", "ingredient_names", "amount_texts", "mended_links", "match_records", "flat_payloads", "stored_payloads", "raw_section_texts", "raw_lists", "extracted_fields",
    "page_texts", "projected_answers", "repaired_pages", "stage_metrics", "cached_lookups", "request_sessions", "located_sections",
    "label_line_counts", "label_walk", "label_sections", "label_top_lines", "label_penalties", "label_scores", "label_lists",
    "request_flow", "split_names", "variant_places",
)

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {n: getattr(queries, n) for n in NAMES}
ORACLE_SQL: dict[str, str] = dict(oracles.SQL)


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return queries.line_section_counts(spark, sf_dir)
