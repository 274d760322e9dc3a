"""Readers and writers of the file formats of narration projects."""
