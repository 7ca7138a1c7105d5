"""Corpus operators for training data: packing, licences, dedup, secrets, decontamination, language ID, LM scoring, token files."""
