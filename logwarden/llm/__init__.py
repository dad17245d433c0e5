"""Operators for preparing large text corpora: filtering, deduplication, mixing, sharding, decontamination.

Nothing else in the library imports this subpackage.
"""
