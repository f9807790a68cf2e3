"""Training-data operators: near duplicates, archives, licences, toxicity, decontamination,
language ID, sharding, URL filters, quality rules and packing.

Self-contained: nothing outside this subpackage imports it, and it imports nothing of the
rest of the library.
"""
