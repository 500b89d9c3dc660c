"""The civic tables' columns, keys and public columns."""

from __future__ import annotations

from pyspark.sql.types import StructType

_DDL = {
    "jurisdictions": "slug STRING, name STRING, region_slug STRING, platform STRING",
    "meetings": """id STRING, external_id STRING, jurisdiction_slug STRING, title STRING, meeting_type STRING, date_text STRING, time_text STRING,
        location STRING, meeting_datetime TIMESTAMP, section STRING, status STRING, source_type STRING, source_url STRING, row_text STRING,
        has_html_agenda BOOLEAN, has_pdf BOOLEAN, llm_input_text STRING, public_comments_input_text STRING, source_hash STRING,
        summarized_source_hash STRING, cards_generated_at TIMESTAMP, extraction_notes ARRAY<STRING>, raw STRING, scraped_at TIMESTAMP,
        created_at TIMESTAMP, updated_at TIMESTAMP""",
    "documents": """id STRING, meeting_id STRING, jurisdiction_slug STRING, type STRING, label STRING, source_url STRING, local_path STRING,
        storage_path STRING, bytes LONG, download_error STRING, extracted_text STRING, extraction_character_count INT, is_scanned BOOLEAN,
        created_at TIMESTAMP""",
    "summary_cards": """id STRING, meeting_id STRING, jurisdiction_slug STRING, source_item_id STRING, agenda_item STRING, what_is_happening STRING,
        what_is_happening_points ARRAY<STRING>, why_it_matters STRING, who_it_affects ARRAY<STRING>, category_tags ARRAY<STRING>, status STRING,
        comment_window_opens STRING, comment_window_closes STRING, how_to_act_attend STRING, how_to_act_email STRING,
        how_to_act_submit_comment STRING, source_url STRING, confidence STRING, is_published BOOLEAN, is_featured BOOLEAN, admin_notes STRING,
        decision_sort_at TIMESTAMP, created_at TIMESTAMP, updated_at TIMESTAMP""",
    "decision_outcomes": """id STRING, summary_card_id STRING, meeting_id STRING, jurisdiction_slug STRING, kind STRING, headline STRING,
        summary STRING, decided_at TIMESTAMP, vote STRING, next_step STRING, source_url STRING, source_hash STRING, source_text STRING,
        matched_item_key STRING, match_method STRING, match_score DOUBLE, created_at TIMESTAMP, updated_at TIMESTAMP""",
    "announcements": """id STRING, title STRING, body STRING, type STRING, jurisdiction_slug STRING, starts_at TIMESTAMP, ends_at TIMESTAMP,
        is_published BOOLEAN, created_at TIMESTAMP""",
    "scraper_runs": """id STRING, jurisdiction_slug STRING, started_at TIMESTAMP, finished_at TIMESTAMP, status STRING, meetings_found INT,
        documents_downloaded INT, cards_generated INT, error STRING""",
    "decision_interests": "summary_card_id STRING, device_card_hash STRING, created_at TIMESTAMP",
    "email_subscribers": "id STRING, email STRING, status STRING, pending_jurisdiction_slugs ARRAY<STRING>, created_at TIMESTAMP",
    "email_subscriptions": """id STRING, subscriber_id STRING, jurisdiction_slug STRING, frequency STRING, last_digest_sent_at TIMESTAMP,
        created_at TIMESTAMP""",
}
TABLES = list(_DDL)


def schema(name: str) -> StructType:
    """The schema of a table (needs an active session, which parses it)."""
    return StructType.fromDDL(_DDL[name])


#: The columns whose values name a row.
KEYS = {
    "jurisdictions": [["slug"]],
    "meetings": [["jurisdiction_slug", "external_id"]],
    "documents": [["jurisdiction_slug", "source_url"]],
    "summary_cards": [["meeting_id", "source_item_id"], ["meeting_id", "agenda_item", "source_url"]],
    "decision_outcomes": [["summary_card_id"], ["meeting_id", "matched_item_key"]],
    "decision_interests": [["summary_card_id", "device_card_hash"]],
    "email_subscriptions": [["subscriber_id", "jurisdiction_slug", "frequency"]],
}
