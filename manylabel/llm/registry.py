"""All queries of this subpackage and the SQL of those that SQL can express."""

from . import bpe_words, gif, hard_negatives, jaccard_join, license_scans, line_dedup, poisson_mixing, quality_classifier, quality_rules, repeated_bytes, spelling, url_filters, warc_derivatives

MODULES = (url_filters, gif, warc_derivatives, line_dedup, license_scans, jaccard_join, quality_rules, poisson_mixing, bpe_words, repeated_bytes, hard_negatives, quality_classifier, spelling)
QUERIES = {name: f for m in MODULES for name, f in m.QUERIES.items()}
SQL = {name: sql for m in MODULES for name, sql in m.SQL.items()}
