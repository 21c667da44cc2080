"""The engine's queries for the driver and their SQL."""

from __future__ import annotations

from . import assets, binaries, catalogs, clusters, compositing, effects, exports, folds, images, maps, motion, palettes, pixels, reduction, rules, screen, segments, streams, tiles

MODULES = (tiles, palettes, screen, maps, motion, assets, folds, streams, pixels, segments, images, rules, catalogs, exports, effects, clusters, binaries, compositing, reduction)
QUERIES: dict = {k: f for m in MODULES for k, f in m.QUERIES.items()}
ORACLE_SQL: dict = {k: s for m in MODULES for k, s in m.ORACLE_SQL.items()}
