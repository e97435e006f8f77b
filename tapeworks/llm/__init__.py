"""Operators that prepare a text corpus for training: filters, deduplication, decontamination, mixing, sharding, archives."""
