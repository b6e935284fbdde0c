"""Readers, writers and the frames derived from the benchmark tables."""
