"""Operators for preparing training data for language models.

Nothing else in the library imports this package.  Task functions travel with
the tasks; executors need the libraries they use, not this package.
"""
