"""Operators of the de-identification engine."""
