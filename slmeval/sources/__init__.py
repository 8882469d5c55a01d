"""Readers and writers: items, run results, device readings, frames."""
