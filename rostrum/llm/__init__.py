"""Training-data operators: deduplication, screening, mixing and storage.

Nothing outside this subpackage imports it.
"""
