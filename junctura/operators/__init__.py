"""Operators on DataFrames: intervals, exons, pairs, breakpoints, candidates, evidence, similarity, samples, models."""
