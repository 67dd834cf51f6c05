"""Operators for preparing training corpora; their queries are in ``queries``."""
