"""Training-data operators: ten document-level operators and their queries.

Nothing else in the library imports this subpackage.
"""
