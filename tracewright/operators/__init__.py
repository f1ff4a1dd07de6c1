"""Stages over targets, findings and events, each from DataFrames to DataFrames."""
