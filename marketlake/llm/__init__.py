"""Operators of a training-data pipeline (decontamination, de-duplication, quality, extraction, packing)."""
