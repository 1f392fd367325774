"""Scores of a run and the reports over them."""
