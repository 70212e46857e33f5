"""Training-data operators: near and exact deduplication, classifiers, chat
formatting, mixing, piece encoding and language identification.

Nothing else in the library imports this subpackage; it imports general
helpers only (session, lineage cutting).
"""
