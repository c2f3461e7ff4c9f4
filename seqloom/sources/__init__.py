"""Readers and writers of sequence, motif and checkpoint files."""
