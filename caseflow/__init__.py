"""Cycle-time analytics over a table of case step visits, as Spark DataFrames."""
