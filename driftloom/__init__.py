"""Simulation-based evaluation of inflation measures, written as Spark DataFrame plans."""
