"""Training-data operators: filters, fingerprints, joins, counts, mixing and scoring of document corpora.

Nothing outside this subpackage imports it.
"""
