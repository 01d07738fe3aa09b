"""Readers and writers: payloads, requests, references, evaluation files, the index."""
