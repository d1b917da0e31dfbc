"""Operators for preparing training text: near-duplicates, classifiers, scans, tokenization.

Nothing else in the package imports this subpackage; ``__spark_entry__`` adds
its queries when it is there.
"""
