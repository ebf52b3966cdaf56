"""Training-data operators: dedup, language ID, PII, tokenisation, packing, WARC, scoring.

Nothing outside this subpackage imports it; ``registry`` holds its queries.
"""
