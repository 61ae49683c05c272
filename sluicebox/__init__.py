"""Batch preparation of nested app events, and whole-table transfers, on Spark."""
