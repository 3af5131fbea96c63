"""Readers and writers for trial, result and diagnostic tables."""
