"""Queries over the driver tables, one module per area."""

from __future__ import annotations

import importlib

AREAS = (
    "telemetry", "quality", "spatial", "hazard", "events", "terrain",
    "text", "labels", "metrics", "models", "streams",
)


def load_all() -> None:
    """Import every area so that its queries are registered."""
    for area in AREAS:
        importlib.import_module(f"slopecast.plans.{area}")
