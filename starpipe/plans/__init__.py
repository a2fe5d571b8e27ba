"""The user-level steps built from the operators."""
