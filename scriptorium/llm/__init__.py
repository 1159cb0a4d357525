"""Training-data operators: dedup, quality, packing, toxicity, decontamination, archives, PII, chat.

Nothing outside this subpackage imports it.
"""
