"""Operators for preparing language-model training data at scale.

Nothing outside this folder imports it.  Each module is one operator with a
general interface; ``registry`` holds the thin ``opN_*`` queries and their SQL.
"""
