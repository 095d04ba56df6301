"""Sources of the de-identification engine."""
