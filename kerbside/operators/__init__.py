"""Relational, telemetry, geometry and document operators over DataFrames."""
