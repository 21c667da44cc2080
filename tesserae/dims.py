"""Fixed values of the domain: dimensions small enough to be literals of a query."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Bounds of the larger side of a sprite, and of the relative height of its centre.
SIZES = {"tiny": (0, 12), "small": (12, 20), "medium": (20, 40), "large": (40, 64), "huge": (64, 256)}
HEIGHTS = {"top": (0.0, 0.3), "middle": (0.3, 0.7), "bottom": (0.7, 1.0)}
# Words of a file name that tell a sprite's type, in order.
NAME_HINTS = {
    "player": ("player", "hero", "char", "protagonist", "main"),
    "enemy": ("enemy", "mob", "monster", "baddie", "foe"),
    "boss": ("boss", "big", "giant", "mega"),
    "item": ("item", "pickup", "powerup", "collect", "coin", "gem"),
    "projectile": ("bullet", "shot", "projectile", "missile", "laser"),
    "vfx": ("effect", "vfx", "particle", "explosion", "spark"),
    "ui": ("ui", "hud", "icon", "button", "menu", "font"),
    "background": ("bg", "background", "tile", "level", "map"),
}
# Ticks of a frame by action, and actions that play once.
TICKS = {"idle": 10, "walk": 6, "run": 4, "attack": 3, "hit": 2, "hurt": 2, "death": 8, "die": 8, "jump": 5, "fall": 5, "land": 3, "shoot": 3, "cast": 6, "charge": 4}
DEFAULT_TICKS = 6
ONE_SHOT = ("attack", "hit", "hurt", "death", "die", "shoot", "cast", "land")
# Collision codes.
COLLISIONS = ("none", "solid", "platform", "ladder", "water", "damage", "trigger", "slope_l", "slope_r")
SOLID = 1
# Default boxes by type as tenths or hundredths of a sprite (hit width, height; hurt width, height; tops, None for centred).
BOXES = {
    "character": (70, 80, 80, 90, 10, 5),
    "projectile": (50, 50, 50, 50, None, None),
    "item": (90, 90, 90, 90, None, None),
    "boss": (60, 60, 85, 85, None, None),
    "other": (80, 80, 80, 80, None, None),
}
BOX_TYPES = {"player": "character", "enemy": "character", "npc": "character", "projectile": "projectile", "bullet": "projectile", "item": "item", "pickup": "item", "boss": "boss"}
# Hardware tiers (number, name, colours a palette, palettes, sprite colours, unique tiles, frames) and their platforms.
TIERS = (
    (0, "MINIMAL", 4, 8, 3, 256, 4, ("nes", "famicom", "gb", "gbc", "c64", "zx", "atari2600", "atari7800", "fc")),
    (1, "MINIMAL_PLUS", 16, 2, 15, 448, 6, ("sms", "gamegear", "msx2", "ngp", "ngpc")),
    (2, "STANDARD", 16, 8, 15, 1024, 8, ("genesis", "megadrive", "snes", "sfc", "pce", "turbografx", "amiga", "md", "tg16")),
    (3, "STANDARD_PLUS", 16, 256, 15, 4096, 12, ("neogeo", "segacd", "32x", "x68000")),
    (4, "EXTENDED", 256, 16, 255, 8192, 16, ("gba", "nds", "psp")),
)
# A scanline's sprites and pixels, a screen's sprites and lines, bytes of a transfer a line, lines of the blank.
PER_LINE, LINE_PIXELS, PER_SCREEN, SCREEN_LINES, DMA_LINE, BLANK_LINES = 20, 320, 80, 224, 168, 40
# A hardware palette of 64 colours, by number.
FIXED_64 = (
    (84, 84, 84), (0, 30, 116), (8, 16, 144), (48, 0, 136), (68, 0, 100), (92, 0, 48), (84, 4, 0), (60, 24, 0), (32, 42, 0), (8, 58, 0), (0, 64, 0), (0, 60, 0), (0, 50, 60), (0, 0, 0), (0, 0, 0), (0, 0, 0),
    (152, 150, 152), (8, 76, 196), (48, 50, 236), (92, 30, 228), (136, 20, 176), (160, 20, 100), (152, 34, 32), (120, 60, 0), (84, 90, 0), (40, 114, 0), (8, 124, 0), (0, 118, 40), (0, 102, 120), (0, 0, 0), (0, 0, 0), (0, 0, 0),
    (236, 238, 236), (76, 154, 236), (120, 124, 236), (176, 98, 236), (228, 84, 236), (236, 88, 180), (236, 106, 100), (212, 136, 32), (160, 170, 0), (116, 196, 0), (76, 208, 32), (56, 204, 108), (56, 180, 204), (60, 60, 60), (0, 0, 0), (0, 0, 0),
    (236, 238, 236), (168, 204, 236), (188, 188, 236), (212, 178, 236), (236, 174, 236), (236, 174, 212), (236, 180, 176), (228, 196, 144), (204, 210, 120), (180, 222, 120), (168, 226, 144), (152, 226, 180), (160, 214, 228), (160, 162, 160), (0, 0, 0), (0, 0, 0),
)
# Numbers of the fixed palette that stand for its one true black, and that one.
BLACKS, BLACK = (0x0D, 0x0E, 0x1D, 0x1E, 0x1F, 0x2E, 0x2F, 0x3E, 0x3F), 0x0F


def lookup(value: Column, entries: dict, default) -> Column:  # noqa: ANN001
    out = F.lit(default)
    for k, v in reversed(entries.items()):
        out = F.when(value == k, F.lit(v)).otherwise(out)
    return out


def band(value: Column, bands: dict, default: str) -> Column:
    """The first band [low, high) that holds ``value``."""
    out = F.lit(default)
    for name, (low, high) in reversed(bands.items()):
        out = F.when((value >= low) & (value < high), name).otherwise(out)
    return out


def name_hint(name: Column) -> Column:
    """The first type one of whose words is in a file name, or null."""
    out, low = F.lit(None).cast("string"), F.lower(name)
    for kind, words in reversed(NAME_HINTS.items()):
        out = F.when(low.rlike("|".join(words)), kind).otherwise(out)
    return out


def tier(platform: Column) -> Column:
    """A platform's tier number; unknown platforms are in the lowest."""
    return lookup(F.lower(platform), {p: t[0] for t in TIERS for p in t[7]}, 0)
