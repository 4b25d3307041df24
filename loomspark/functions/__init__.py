"""Scalar rules: quotas, coverage counts, step grids, seeded order."""
