"""Operators of a training-data pipeline (de-duplication, secrets, PII, URL and
HTML cleaning, quality, mixing, decontamination).  Nothing else in the library
imports this subpackage."""
