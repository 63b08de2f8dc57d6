"""Registered query plans and their SQL."""
