"""Operators of a large-scale training-data pipeline; nothing else in seqlake imports this subpackage."""
