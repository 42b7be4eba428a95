"""Readers and writers of corpus tables."""
