"""Station-climate hazard analytics as composable Spark DataFrame operators."""
