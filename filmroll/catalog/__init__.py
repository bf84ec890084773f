"""Every query, over the domain tables derived from the given ones."""

from importlib import import_module

AREAS = ("pixel_queries", "tone_queries", "point_queries", "scan_queries", "roll_queries", "source_queries",
         "stream_queries")


def load():
    """The registry, with every area's queries in it."""
    for area in AREAS:
        import_module(f"filmroll.catalog.{area}")
    return import_module("filmroll.catalog.registry")
