"""Readers and writers of corpora, label files, charts and logs."""
