"""Operators for preparing training data: dedup, decontamination, counting, filtering, mixing, formatting.

Nothing else in the package imports this one. Functions sent to executors carry their code along.
"""
