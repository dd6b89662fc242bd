"""Content-reuse and channel-network analytics as composable Spark DataFrame operators."""
