"""Corpus statistics over streams of sequences."""
