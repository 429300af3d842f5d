"""Training-data operators: filters, classifiers, deduplication, tokenization and sharding.

Nothing outside this subpackage imports it; ``queries.py`` holds the registered queries.
"""
