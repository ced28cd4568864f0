"""Training-data operators: dedup, sharding, tokens, classifiers, filters, chat.

Nothing outside this subpackage imports it.
"""
