"""Sketchloom: how the distribution of a metric varies through time, on Spark."""
