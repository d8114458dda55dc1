"""Relational, window, graph and evaluation operators on DataFrames."""
