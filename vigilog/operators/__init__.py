"""Batch and stream transforms, one module per stage."""
