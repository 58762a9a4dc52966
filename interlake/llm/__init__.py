"""Training-data operators (language, packing, toxicity, dedup, mixing, media, token files).

Nothing outside this subpackage imports it.
"""
