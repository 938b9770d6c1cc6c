"""Relational, ordered-sequence and table-upkeep operators."""
