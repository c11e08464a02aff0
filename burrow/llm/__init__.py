"""Operators for preparing training text at corpus scale.

Nothing outside this subpackage imports it. Every operator is a function from DataFrame to
DataFrame; ``queries.py`` holds the thin registered queries.
"""
