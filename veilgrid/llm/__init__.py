"""Training-data operators: ten corpus-scale components and their queries.

Nothing outside this subpackage imports it.
"""
