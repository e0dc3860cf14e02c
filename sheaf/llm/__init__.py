"""Operators of a training-data pipeline over tables of documents, pages and conversations.

Each module holds one operator with its own interface; ``queries`` registers one query per
operator. Nothing else of the package imports this subpackage.
"""
