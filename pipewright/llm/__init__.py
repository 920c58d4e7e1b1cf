"""Training-data operators: dedup, tokenisation, packing, scoring, licence scans and chat repair.

Nothing outside this subpackage imports it.  ``registry.queries()`` lists the driver queries.
"""
