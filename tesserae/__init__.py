"""Tile, sprite, palette, map, timeline and change-event analytics as composable PySpark DataFrame operators."""
