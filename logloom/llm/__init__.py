"""Training-data operators (quality, near-duplicates, personal data, secrets, licences, tokens).

Each module holds one operator with a general interface and the thin query that
applies it to its table.  Nothing outside this folder imports it except the
driver contract and ``corpus_pipeline.py``.
"""
