"""Readers, writers and the adapters that give the synthetic tables the shape of papers."""
