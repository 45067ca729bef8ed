"""Operators for large training corpora: packing, scanning, sharding, mixing, deduplication, search."""
