"""Operators for preparing language-model training data at cluster scale.

Nothing outside this subpackage imports it. Each module holds one operator with
a general interface over DataFrames; ``queries`` derives the contracted digests.
"""
