"""Operators for preparing text and vector collections for model training.

Nothing outside this package imports it; deleting it leaves the rest intact.
"""
