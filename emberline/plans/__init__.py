"""Compilation of declarative rules into Catalyst expressions."""
