"""Operators of a training-data pipeline over document, page and embedding tables.

Nothing outside this subpackage imports it.  Each operator keeps a general ``DataFrame -> DataFrame``
interface; the thin queries over the test tables are in ``queries``.
"""
