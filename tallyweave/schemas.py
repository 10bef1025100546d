"""Shapes of the tables that the linkage operators take, as DDL."""

from tallyweave.functions.sequence import TYPE as SEQUENCE

IDENTIFIERS = "array<struct<scheme: string, value: string>>"
CREDITS = "array<struct<name: string, role: string>>"

LOCAL = (
    "source_id string, kind string, subtype string, classification_confidence double, title string, creators array<string>, "
    f"identifiers {IDENTIFIERS}, series_title string, sequence {SEQUENCE}, year int, run_start_year int, publisher string, language string, edition_qualifiers array<string>"
)
CANDIDATES = (
    f"candidate_key string, provider string, provider_id string, record_type string, media_kind string, title string, subtitle string, creators {CREDITS}, "
    f"identifiers {IDENTIFIERS}, publisher string, publication_date string, release_date string, release_date_precision string, cover_date string, "
    f"cover_date_precision string, language string, series_title string, run_start_year int, sequence {SEQUENCE}, item_type string, work_id string, "
    "edition_id string, run_id string, provider_metadata map<string, string>, provider_schema_version int"
)
DECISIONS = (
    "id bigint, source_fingerprint string, media_signature string, decision_type string, candidate_key string, source_evidence_hash string, "
    "candidate_data_hash string, payload_json string, created_at timestamp, supersedes_id bigint, batch_id string"
)
#: A scored comparison of one field.
COMPARISON = "struct<field: string, local_value: string, candidate_value: string, kind: string, score_delta: double, confidence: double, reason: string>"
