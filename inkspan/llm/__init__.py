"""Operators that prepare training data for language models.

Nothing else in the library imports this subpackage.  ``entries`` holds the
registered queries and their SQL.
"""
