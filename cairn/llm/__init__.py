"""Operators for training-data pipelines. Nothing else in cairn imports this subpackage."""
