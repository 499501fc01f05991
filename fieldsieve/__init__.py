"""Cleaning, checking and summarising field-survey tables with Spark DataFrames."""
