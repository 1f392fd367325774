"""Scans and sinks. Every schema is declared; nothing is inferred."""
