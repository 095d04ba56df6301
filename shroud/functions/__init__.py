"""Functions of the de-identification engine."""
