"""Text expressions: identifiers, file names, labels, secrets, human-readable sizes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Categories and gameplay states of an asset label that are one word, and words for a variant.
CATEGORIES = tuple("player enemy npc boss projectile item pickup weapon background foreground tileset parallax vfx particle explosion hud menu font icon music sfx".split())
STATES = tuple("idle walk run jump fall crouch crawl climb swim attack shoot throw block dodge hurt knockback death revive interact pickup talk spawn despawn transform charge victory defeat".split())
VARIANTS = tuple("blue red green gold damaged alt".split())
# Names that a file system reserves, and words that mark a secret's key.
RESERVED = ("CON", "PRN", "AUX", "NUL", *(f"{d}{n}" for d in ("COM", "LPT") for n in range(1, 10)))
SECRETS = ("api_key", "apikey", "token", "secret", "password", "passwd", "auth", "authorization", "credential", "private_key")


def c_identifier(name: Column) -> Column:
    """Lower case; anything but letters, digits and ``_`` becomes ``_``, and a digit or nothing at the start gets one."""
    out = F.regexp_replace(name, r"[^\p{L}\p{N}_]", "_")
    out = F.when(out.rlike("^[0-9]"), F.concat(F.lit("_"), out)).otherwise(out)
    return F.lower(F.when(out == "", "unnamed").otherwise(out))


def pascal(name: Column) -> Column:
    return F.regexp_replace(F.initcap(F.regexp_replace(name, "[^A-Za-z0-9]+", " ")), " ", "")


def upper_snake(name: Column) -> Column:
    return F.upper(F.regexp_replace(name, "[^A-Za-z0-9]+", "_"))


def safe_filename(name: Column, replacement: str = "_") -> Column:
    """Path separators and unsafe characters replaced, dots and spaces at the ends gone, reserved names marked, 255 characters at most with the extension kept."""
    out = F.btrim(F.regexp_replace(name, '[/\\\\<>:"|?*\\x00\\r\\n\\t]', replacement), F.lit(". "))
    stem = F.upper(F.regexp_replace(out, r"(?<=.)\.[^.]*$", ""))
    out = F.when(stem.isin(*RESERVED), F.concat(F.lit(replacement), out)).otherwise(out)
    out = F.when(out == "", "unnamed").otherwise(out)
    extension = F.regexp_extract(out, r"(?<=.)(\.[^.]+)$", 1)
    short = F.concat(F.substring(F.regexp_replace(out, r"(?<=.)\.[^.]+$", ""), F.lit(1), 255 - F.length(extension)), extension)
    return F.when(F.length(out) > 255, short).otherwise(out)


def mask_secret(value: Column, visible: int = 4) -> Column:
    """Both ends of a long secret, else three stars."""
    return F.when(F.coalesce(F.length(value), F.lit(0)) <= 2 * visible, "***").otherwise(F.concat(F.substring(value, 1, visible), F.lit("..."), F.right(value, F.lit(visible))))


def mask_map(values: Column) -> Column:
    """A map with the values of secret keys masked."""
    return F.transform_values(values, lambda k, v: F.when(F.lower(k).rlike("|".join(SECRETS)), mask_secret(v)).otherwise(v))


def _fixed(value: Column, places: int) -> Column:
    """With so many decimals, ties to even."""
    return F.format_string(f"%.{places}f", F.bround(value, places))


def size(bytes_: Column) -> Column:
    """Like ``1.5KB``."""
    out = F.concat(_fixed(bytes_ / F.lit(1024.0**4), 1), F.lit("TB"))
    for power, unit in reversed(list(enumerate(("B", "KB", "MB", "GB")))):
        out = F.when(bytes_ < 1024 ** (power + 1), F.concat(_fixed(bytes_ / F.lit(1024.0**power), 1), F.lit(unit))).otherwise(out)
    return out


def duration(seconds: Column) -> Column:
    """Like ``250ms``, ``4.2s``, ``3m 5s`` or ``2h 7m``."""
    whole = lambda c: F.floor(c).cast("long").cast("string")
    minutes, hours = F.floor(seconds / 60), F.floor(seconds / 3600)
    return (
        F.when(seconds < 1, F.concat(_fixed(seconds * 1000, 0), F.lit("ms")))
        .when(seconds < 60, F.concat(_fixed(seconds, 1), F.lit("s")))
        .when(seconds < 3600, F.concat(whole(minutes), F.lit("m "), _fixed(seconds - minutes * 60, 0), F.lit("s")))
        .otherwise(F.concat(whole(hours), F.lit("h "), whole((seconds - hours * 3600) / 60), F.lit("m")))
    )


def label(filename: Column) -> Column:
    """Struct (category, name, state, frame, variant) that a file name like ``enemy_slime_attack_f01.png`` tells.

    The last word of a kind counts. A word that is both a category and a state is a category. Words of no kind make the name, but those
    after the first that name a variant.
    """
    stem = F.lower(F.regexp_replace(F.regexp_replace(filename, r"^.*[/\\]", ""), r"(?<=.)\.[^.]*$", ""))
    parts = F.split(F.replace(stem, F.lit("-"), F.lit("_")), "_")
    is_in = lambda p, words: F.array_contains(F.array(*map(F.lit, words)), p)
    last = lambda kind: F.get(F.reverse(F.filter(parts, kind)), F.lit(0))
    category = lambda p: is_in(p, CATEGORIES)
    state = lambda p: ~category(p) & is_in(p, STATES)
    frame = lambda p: ~category(p) & ~state(p) & p.rlike(r"^f(rame)?[0-9]+$")
    rest = F.filter(parts, lambda p: ~category(p) & ~state(p) & ~frame(p))
    first, others = F.get(rest, F.lit(0)), F.slice(rest, F.lit(2), F.greatest(F.size(rest) - 1, F.lit(0)))
    # a first word "unknown" reads as no name yet
    variant = F.get(F.reverse(F.filter(others, lambda p: is_in(p, VARIANTS))), F.lit(0))
    name = F.array_join(F.concat(F.array(first), F.filter(others, lambda p: ~is_in(p, VARIANTS))), "_")
    return F.struct(
        F.coalesce(last(category), F.lit("item")).alias("category"), F.when(F.size(rest) > 0, name).otherwise("unknown").alias("name"), last(state).alias("state"),
        F.regexp_extract(last(frame), "([0-9]+)$", 1).cast("int").alias("frame"), variant.alias("variant"),
    )


def label_filename(lab: Column, extension: str = ".png") -> Column:
    frame = F.when(lab["frame"].isNotNull(), F.concat(F.lit("f"), F.lpad(lab["frame"].cast("string"), 2, "0")))
    return F.concat(F.concat_ws("_", lab["category"], lab["name"], lab["state"], frame, lab["variant"]), F.lit(extension))


def prefix_category(name: Column, prefixes: dict[str, str], default: str = "misc") -> Column:
    """The category of the first prefix that a name starts with."""
    out = F.lit(default)
    for prefix, category in reversed(prefixes.items()):
        out = F.when(F.lower(name).startswith(prefix), category).otherwise(out)
    return out
