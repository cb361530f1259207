"""Matching tasks as plans."""
