"""Operators for large-scale training-data pipelines.

Nothing outside this subpackage imports it; deleting the folder leaves the rest of the library whole.
"""
