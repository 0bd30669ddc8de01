"""Whole pipelines: boundary detection, extraction, delta, merge, import and export."""
