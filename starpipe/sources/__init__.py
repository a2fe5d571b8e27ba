"""Readers: landing CSV, layers, dictionaries, metrics and event logs."""
