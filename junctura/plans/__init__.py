"""Whole plans: calls of fusions for one sample or many, training sequences, and the catalogue of queries."""
