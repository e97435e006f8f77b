"""Time-series bar analytics as plain ``DataFrame -> DataFrame`` functions on Spark."""
