"""Operators of a training-data pipeline: deduplication, language and
toxicity models, URL rules, packing, token counts, decontamination and
nearest neighbours.  Nothing outside this subpackage imports it."""
