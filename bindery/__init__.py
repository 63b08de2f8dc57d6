"""Ebook corpora on Spark."""
