"""Readers and writers of the scan datasets."""
