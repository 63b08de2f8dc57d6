"""Operators over the tables of an ebook corpus."""
