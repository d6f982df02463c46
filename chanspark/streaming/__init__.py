"""Measurement files as a stream."""
