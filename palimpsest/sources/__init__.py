"""Readers, writers and the versioned table that publishes atomically."""
