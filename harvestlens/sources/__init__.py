"""Readers, writers, snapshot versions and model artifacts."""
