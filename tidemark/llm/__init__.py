"""Training-data operators.

Nothing outside this package imports it.  Each module holds one operator with a general
interface; ``registry`` holds the thin queries and their SQL.
"""
