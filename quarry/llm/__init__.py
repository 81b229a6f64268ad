"""Training-data operators: extraction, archives, filtering, deduplication, packing.

Nothing outside this subpackage imports it; the query registry adds its entries
only when the subpackage is present.
"""
