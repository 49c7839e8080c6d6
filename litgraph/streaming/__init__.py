"""Operators over usage events that run on batches and on streams."""
