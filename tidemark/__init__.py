"""Versioned, ordered key-value tables on Spark.

A table is a *change log* ``(key, seq, value)``: the row with the highest ``seq`` of a key is its
current version, and a null ``value`` is a tombstone.  ``operators`` are functions from frames to
frames over such logs, ``sources`` holds the Parquet store with its manifest, ``functions`` the
column functions, ``plans`` the registered queries and ``streaming`` the ingest from streams.
"""
