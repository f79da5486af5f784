"""Operators for preparing training corpora, each a job over a ``documents`` table (doc_id, text, ...).

Nothing outside this subpackage imports it.  ``registry`` holds the queries and their SQL.
"""
