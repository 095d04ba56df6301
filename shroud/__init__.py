"""De-identification analytics on Spark."""
