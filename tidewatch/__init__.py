"""Tidewatch: explainable regional news signals on Spark."""
