"""Training-data operators: tokens, packing, dedup, quality, PII, archives, URLs.

Nothing outside this folder imports it; ``queries()`` and ``oracle_sql()`` of
``quillstone.llm.registry`` are picked up by the entry module when present.
"""
