"""Operators over sequence corpora and motifs."""
