"""Readers and flatteners that turn raw inputs into the canonical tables."""
