"""Operators for training-data pipelines over documents and conversations.

Nothing else in the library imports this package.
"""
