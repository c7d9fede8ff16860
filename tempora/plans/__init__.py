"""Queries over the driver's tables, with their SQL."""

from __future__ import annotations

from . import checks, circular, decoding, events, geometry, images, loops, mixtures, parts, recordings, segments, shapes, signals

MODULES = (segments, events, circular, signals, decoding, geometry, shapes, loops, mixtures, images, checks, parts, recordings)

QUERIES = {name: query for m in MODULES for name, query in m.QUERIES.items()}
ORACLE_SQL = {name: sql for m in MODULES for name, sql in m.ORACLE_SQL.items()}
