"""Text-memory retrieval, lifecycle and telemetry analytics as Spark jobs."""
