"""Slope-hazard analytics as Spark jobs: rainfall telemetry, terrain, soil, risk."""
