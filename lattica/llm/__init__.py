"""Operators for large training-text pipelines. Nothing else in lattica imports this subpackage."""
