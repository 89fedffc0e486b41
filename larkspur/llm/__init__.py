"""Operators for preparing training corpora: deduplication, search, scans, classifiers, sharding, mixing."""
