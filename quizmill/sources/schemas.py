"""Schemas of the seven tables, the crawl files and the extraction record."""

from __future__ import annotations

TABLES = {
    "companies": "id long, canonical string, industry string, created_at timestamp",
    "positions": "id long, canonical string, category string, level string, created_at timestamp",
    "posts": "id long, source_url string, title string, raw_html string, cleaned_text string, posted_at timestamp, fetched_at timestamp, quality_score int, extract_status string, extract_error string, extract_version int",
    "links": "post_id long, company_id long, position_id long",
    "questions": "id long, post_id long, round_no int, round_type string, content string, category string, answer_brief string, embedding array<float>, created_at timestamp, answer_ai string, answer_ai_version int",
    "summaries": "id long, company_id long, position_id long, period string, content_md string, sample_count int, candidate_count int, updated_at timestamp",
    "alias_dict": "id long, entity_type string, alias string, canonical_id long, confidence float, learned_at timestamp",
}

#: One post of a crawl file.
CRAWL_POST = "title string, content string, detail_url string, created_at string, created_at_ms long, author string, school string, major string, auth_display string, ip_location string, view_count long, like_count long, comment_count long, content_type int, content_id string, uuid string"

#: One record as the site's interface returns it.
API_RECORD = (
    "contentType int, contentId string, "
    "momentData struct<id string, uuid string, title string, newTitle string, content string, createdAt long, ip4Location string>, "
    "userBrief struct<nickname string, educationInfo string, secondMajorName string, authDisplayInfo string>, "
    "frequencyData struct<viewCnt long, likeCnt long, totalCommentCnt long, commentCnt long>, "
    "extraInfo struct<contentID_var string>"
)

EXTRACTION = (
    "companies array<string>, positions array<string>, level string, interview_date string, "
    "rounds array<struct<round_no int, round_type string, questions array<struct<content string, category string, answer_brief string>>>>"
)
