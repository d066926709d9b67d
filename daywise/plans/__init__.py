"""Validated plan, window and contract objects that compile to column expressions."""
