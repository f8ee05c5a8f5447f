"""gearwatch: equipment-risk panel analytics written as plain Spark jobs."""

from gearwatch.panel import EQUIPMENT, PANEL, PanelSpec

__all__ = ["EQUIPMENT", "PANEL", "PanelSpec"]
