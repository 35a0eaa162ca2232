"""Comparison of time series across labelled, half-open time windows, as Spark jobs."""
