"""Declared schemas: nothing is inferred."""

from __future__ import annotations

ARTICLES = """record_id string, source_code string, source_article_id string, story_id string, language string, title_original string,
excerpt_original string, body_original string, body_method string, published_at string, date_precision string, china_note_zh string,
topic_labels array<string>, content_origin string, matched_queries array<string>, original_url string, archive_url string, search_url string,
body_file string, raw_file string, evidence_grade string, retrieval_tier string, content_sha256 string, ocr_confidence double, retrieved_at string, metadata string"""
CLUSTERS = "story_id string, source_code string, representative_record_id string, cluster_method string, confidence double, manual_status string"
EVIDENCE = "evidence_id string, record_id string, evidence_type string, evidence_grade string, evidence_url string, local_file string, content_sha256 string, observed_at string, title_match boolean, date_match boolean, notes string"
PARTITIONS = "partition_id string, source_code string, query string, date_from string, date_to string, page int, expected_hits int, parsed_rows int, status string, attempts int, last_checked_at string, error string"
SAMPLES = "sample_id string, story_id string, record_id string, source_code string, year_month string, selection_rank int, score double, quota_reason string, selected_at string"
TRANSLATIONS = "record_id string, story_id string, source_language string, body_sha256 string, body_file string, translation_status string, provider string, model string, prompt_hash string, queued_at string, completed_at string"
COVERAGE_CSV = "source string, year_month string, candidate_story_count int, eligible_story_count int, qualified_body_story_count int, sample_story_count int, coverage_status string, partial_period int, gap_reason string"
INDEX_ROW = "urlkey string, timestamp string, url string, mime string, status string, digest string, length string, offset string, filename string, languages string"
ARQUIVO_ROW = "url string, timestamp string, digest string, mime string, status string"
TSV_WORDS = "level int, page_num int, block_num int, par_num int, line_num int, word_num int, left int, top int, width int, height int, conf double, text string"
PAGES = "array<struct<page_num int, text string, text_items array<struct<text string, x double, y double, width double, height double>>>>"
EXPORT_FIELDS = ("record_id", "story_id", "source_code", "language", "title_original", "published_at", "date_precision", "evidence_grade", "retrieval_tier", "content_origin", "topic_labels", "original_url", "archive_url", "body_file", "content_sha256", "china_note_zh")
