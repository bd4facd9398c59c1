"""Dubito: analytics over sampled answers and their uncertainty, on Spark."""
