"""The queries of this subpackage and their SQL, for the entry module."""

from geoflume.llm import decontaminate, hard_negatives, html_text, jaccard_join, line_dedup, mixing, quality_rules, secret_scan, substring_dedup, topk_search, toxicity, url_filter, whitening

_MODULES = (substring_dedup, line_dedup, url_filter, jaccard_join, decontaminate, toxicity, html_text, secret_scan, topk_search, mixing, quality_rules, hard_negatives, whitening)
QUERIES = {k: v for m in _MODULES for k, v in m.QUERIES.items()}
ORACLE = {k: v for m in _MODULES for k, v in m.ORACLE.items()}
