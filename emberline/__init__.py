"""Telemetry analytics for fleets of zoned heating sites, written as Spark DataFrame operators."""
