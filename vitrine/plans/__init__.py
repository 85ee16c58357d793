"""Registered end-to-end plans and their SQL oracles."""
