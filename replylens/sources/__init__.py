"""Readers, writers and the stored-result layout."""
