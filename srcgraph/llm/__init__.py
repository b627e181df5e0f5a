"""Training-data operators: packing, secrets, dedup, language, sharding, toxicity, WARC and mixing.

Nothing else in the library imports this subpackage.
"""
