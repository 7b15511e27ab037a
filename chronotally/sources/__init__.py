"""Readers that turn raw records into canonical events, and writers."""
