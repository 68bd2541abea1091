"""Readers, writers, and the bindings of domain tables to the star schema."""
