"""Training-data operators: packing, archives, mixing, dedup, toxicity, media and token files.

Nothing outside this subpackage imports it.
"""
