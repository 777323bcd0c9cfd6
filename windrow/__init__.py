"""windrow: sensor-telemetry processing on Spark DataFrames and streams."""
