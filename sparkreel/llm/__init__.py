"""Operators for preparing training text at scale.

Nothing outside this folder imports it; each module is one operator with a
general interface, and ``queries`` holds the thin registered queries.
"""
