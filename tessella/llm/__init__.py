"""Operators for preparing training text at scale.

Nothing outside this subpackage imports it; ``queries`` and ``sql`` hold what
``__spark_entry__`` registers.
"""
