"""Operators of a training-data pipeline over the documents and pages tables.

Nothing else in the package imports this subpackage; it may import the
general helpers of ``ledgerlens.session``.
"""
