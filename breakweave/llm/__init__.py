"""Training-data operators: media columns, near-duplicate joins, dedup, rollups, classifiers, URL rules, BPE.

Nothing outside this subpackage imports it; ``queries.py`` lists what the entry module registers.
"""
