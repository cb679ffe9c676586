"""Readers, writers and stored snapshots."""
