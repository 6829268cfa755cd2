"""Explicit schemas of all stored tables. Nothing is ever inferred."""

from __future__ import annotations

PAGES = "page_id long, url string, html string"
FETCH_META = (
    "page_id long, status_code int, load_time_ms long, headers map<string,string>, error string"
)
ROBOTS = "site_key string, robots_txt string"
SITEMAP_DOCS = "site_key string, sitemap_url string, body string"
SITES = "site_key string, base_url string"
URL_STATUS = "url string, status int"
PROBES = (
    "site_key string, https_enforced boolean, www_resolves boolean, apex_resolves boolean, "
    "canonicalized boolean"
)
LAB_PAYLOADS = "site_key string, strategy string, body string"
FIELD_PAYLOADS = "site_key string, http_status int, body string"
DNS_ANSWERS = "site_key string, rtype string, name string, data string, pos int"
THREAT_SCANS = "site_key string, available boolean, message string"
THREAT_MATCHES = "site_key string, threat_type string, pos int"
HTML_MESSAGES = "site_key string, type string, message string, last_line int, pos int"
AUTHORITY = (
    "site_key string, rank_integer int, rank_decimal double, status_code int, error string"
)
HEADER_SCANS = (
    "site_key string, available boolean, source string, grade string, score int, "
    "tests_passed int, tests_failed int, "
    "failed_tests array<struct<name:string,score_description:string>>, message string"
)
AUDITS = (
    "audit_id long, url string, domain string, status string, overall_score int, "
    "category_scores map<string,int>, pages_crawled int, total_issues int, critical_count int, "
    "warning_count int, notice_count int, client_ip string, error_message string, "
    "created_at timestamp, completed_at timestamp"
)
AUDIT_PAGES = (
    "audit_id long, page_id long, page_seq long, url string, title string, "
    "meta_description string, h1 string, h1_count int, word_count int, canonical string, "
    "is_indexable boolean, has_social_tags boolean, has_schema boolean, status_code int, "
    "load_time_ms long"
)
AUDIT_ISSUES = (
    "audit_id long, issue_id long, page_id long, stage int, page_seq long, rule_seq int, "
    "issue_key string, category string, severity string, title string, description string, "
    "recommendation string, affected_url string, ai_recommendation string"
)
PAYMENTS = (
    "payment_id string, status string, amount_paise long, order_id string, audit_id long, "
    "created_at timestamp, paid_at timestamp"
)
PAYMENT_EVENTS = (
    "seq long, event string, order_id string, payment_id string, email string, contact string, "
    "method string, error_code string, error_description string"
)
ANSWERS = "audit_id long, batch_no int, body string"
