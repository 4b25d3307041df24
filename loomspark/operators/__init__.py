"""Relational and learning operators over DataFrames."""
