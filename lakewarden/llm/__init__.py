"""Operators on corpora and model runs.  Nothing outside this subpackage imports it."""
