"""Readers of time series, windows and documents, and writers of results."""
