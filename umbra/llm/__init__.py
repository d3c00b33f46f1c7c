"""Operators for preparing training corpora. Nothing else in the package imports this subpackage."""
