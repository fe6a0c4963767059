"""Streams of predictions, as cells finish one by one."""
