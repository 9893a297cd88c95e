"""Training-data operators: filters, deduplication, scans, search and mixing.

Nothing else in the library imports this subpackage. ``QUERIES`` and
``ORACLES`` of :mod:`lumenfold.llm.registry` hold the registered queries.
"""
