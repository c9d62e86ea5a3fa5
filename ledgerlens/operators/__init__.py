"""Audit operators: DataFrame -> DataFrame detectors and their summaries."""
