"""Training-data operators: storage, sharding, quality, deduplication, tokens, scoring, extraction and archives.

Nothing outside this subpackage imports it. Each module holds one operator with a general interface;
``queries`` derives the contract's digest columns from them.
"""
