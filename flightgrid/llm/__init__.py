"""Operators for building and cleaning large language-model training corpora.

Nothing else in the library imports this subpackage.  ``registry`` lists the
queries; every other module is one operator with its own interface.
"""
