"""Schemas of the library's tables (DDL)."""

CUE = "file_id string, cue_no int, start_ms bigint, end_ms bigint, text string, flagged boolean, flag_reason string"
CUE_AUDIT = CUE + ", original_text string, rule_hints array<string>, deleted boolean"
ALIGNMENT = "align_score double, confidence double, status string, match_method string, align_source string, matched_cue_ids array<int>, manual_placement boolean"
WORDS = "words array<struct<word string, start double, end double, confidence double>>"
TRANSCRIPT = f"file_id string, cue_no int, start_ms bigint, end_ms bigint, text string, language string, confidence double, {WORDS}"
PLATFORM = (
    "platform_key string, family string, version string, name string, max_chars_per_line int, max_chars_italics int, max_lines int, min_duration_seconds double, max_duration_seconds double, "
    "min_interval_seconds double, reading_speed_target_cps int, reading_speed_max_cps int, zero_subtitle_required boolean, remove_elements array<string>, rules array<string>, "
    "subtitler_rules array<string>, profanity_table map<string,string>, two_speaker_format string, file_naming_format string, is_custom boolean, created_at timestamp"
)
DEFECT = "file_id string, check_no int, type string, severity string, line_id int, detail string"
GUIDELINE = (
    "id bigint, client string, ott_platform string, spec string, title string, body string, year int, version_no int, is_current boolean, supersedes_id bigint, "
    "created_at timestamp, updated_at timestamp"
)
JOB = "filename string, format string, platform_key string, structure string, total_lines int, flagged_lines int, status string, created_at timestamp"
ANCHOR = "file_id string, ref_s double, client_s double"
LAYOUT_WORD = "doc_id string, page int, y double, x0 double, x1 double, text string, font string"
