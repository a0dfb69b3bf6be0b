"""Operators that prepare text corpora for training: filters, near-duplicate removal, counting and packing."""
