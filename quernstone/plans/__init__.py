"""Whole queries, each with its SQL where SQL can say it."""
