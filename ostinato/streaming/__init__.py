"""Stateful near-live operators."""
