"""Incremental refresh and live state."""
