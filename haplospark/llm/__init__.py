"""Operators for large text corpora: mixing, dedup, decontamination, sharding, encoding and archives.

Nothing outside this subpackage imports it; ``__spark_entry__.py`` adds its queries when it is present.
"""
