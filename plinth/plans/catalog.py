"""All query modules, imported so that the registry is full."""

from . import aggregates, clouds, datasets, expressions, files, images, joins, localisation, planning, predicates, rankings, registration, rooms, routing, searching, streams, surfaces, walkable
from .registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES", "aggregates", "clouds", "datasets", "expressions", "files", "images", "joins", "localisation", "planning", "predicates", "rankings", "registration", "rooms", "routing", "searching", "streams", "surfaces", "walkable"]
