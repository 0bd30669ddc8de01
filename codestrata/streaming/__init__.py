"""Incremental application of a stream of deltas."""
