"""Whole dataset builds, composed from the operators."""
