"""Operators for preparing language-model training data.

Nothing else in the package imports this subpackage; it can be deleted
without affecting the graph, linear-algebra and telemetry operators.
"""
