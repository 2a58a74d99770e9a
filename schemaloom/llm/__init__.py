"""Operators for training-data pipelines over tables of documents, pages and conversations.

Nothing else in the library imports this package.
"""
