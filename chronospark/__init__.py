"""Time-series measurement analytics on Apache Spark."""
