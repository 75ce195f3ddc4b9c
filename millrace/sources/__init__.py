"""Readers and writers of records, documents, plans, themes and corpora."""
