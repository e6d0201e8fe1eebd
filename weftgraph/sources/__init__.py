"""Readers and text extractors that turn raw inputs into rows."""
