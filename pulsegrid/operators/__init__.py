"""Operators over signals (array or long form) and their events, as DataFrames in and out."""
