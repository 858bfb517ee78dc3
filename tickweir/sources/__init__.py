"""Readers, writers and generators of books and trade tapes."""
