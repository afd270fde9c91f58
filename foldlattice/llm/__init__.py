"""Training-data operators: dedup, encoding, packing, scoring and filtering of document tables.

Nothing outside this package imports it; ``registry`` lists its queries.
"""
