"""Relational, stream, graph and hierarchy operators over DataFrames."""
