"""Whole analyses built of operators."""
