"""Operators for training corpora: each module is one operator; `queries` registers them.

Nothing outside this package and its tests imports it.
"""
