"""Streaming of the de-identification engine."""
