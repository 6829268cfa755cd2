"""Readers and writers for the tables the audit works on."""
