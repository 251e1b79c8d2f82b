"""Training-data operators: cleaning, filtering, deduplication, mixing, packing and formatting of text corpora.

Nothing outside this subpackage imports it. ``registry`` holds the registered queries and their SQL.
"""
