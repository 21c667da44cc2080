"""Doc comments of C and assembly sources with the symbols that they stand before, from lines keyed by file."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.sequential import sorted_fold

#: What a declaration's line names, in this order.
SYMBOLS = (
    ("macro", re.compile(r"#\s*define\s+(\w+)")),
    ("type", re.compile(r"typedef\b.*?(\w+)\s*;\s*$")),
    ("type", re.compile(r"(?:struct|enum|union)\s+(\w+)\s*\{?\s*$")),
    ("function", re.compile(r"[\w\s*]+?\b(\w+)\s*\(")),
    ("proc", re.compile(r"\.proc\s+(\w+)")),
    ("label", re.compile(r"(\w+):")),
)
_TOKEN = re.compile(r"/\*\*(?!/)|/\*|\*/|//|;|\"(?:\\.|[^\"\\])*\"|'(?:\\.|[^'\\])*'")


def symbol_of(code: str) -> tuple[str, str] | None:
    code = code.strip()
    return next(((kind, m[1]) for kind, pattern in SYMBOLS if (m := pattern.match(code))), None)


class Scanner:
    """Where a file's lines stand: how deep in comments, in which doc comment, whether one waits for its symbol, and the section. The state has a fixed size."""

    def __init__(self) -> None:
        self.depth, self.doc, self.count, self.waiting, self.banner, self.section = 0, False, 0, False, False, ""

    def line(self, text: str) -> tuple[str | None, str]:
        """The line's part of a doc comment (null outside of one), and its code."""
        at, code, said = 0, [], []
        inside = self.doc and self.depth > 0
        stripped = text.strip()
        if not self.depth and stripped.startswith(";;"):
            if not self.waiting or not self.doc:
                self.count += 1
            self.doc, self.waiting = True, True
            return stripped.lstrip(";").strip(), ""
        if not self.depth and re.match(r"/\*\s*[=-]{2}", stripped):
            self.banner = True
        while at < len(text):
            m = _TOKEN.search(text, at)
            part = text[at : m.start() if m else len(text)]
            if self.depth:
                if m and m[0][0] in "\"'" or m and m[0] in ("//", ";"):  # quotes and line marks mean nothing inside a comment
                    part = text[at : m.start() + 1]
                    said.append(part)
                    at = m.start() + 1
                    continue
                said.append(part)
                if not m:
                    break
                self.depth += 1 if m[0].startswith("/*") else -1
                if self.depth:
                    said.append(m[0])
                elif self.doc:
                    self.waiting = True
                at = m.end()
                continue
            code.append(part)
            if not m or m[0] in ("//", ";") and not (m[0] == ";" and self._c(text)):
                break
            if m[0] == "/**" or m[0] == "/*":
                self.depth, self.doc = 1, m[0] == "/**" and not self.banner
                if self.doc:
                    self.count, inside = self.count + 1, True
            else:
                code.append(m[0])
            at = m.end()
        words = "".join(said).strip().strip("=-* \t")
        if self.banner:
            if words:
                self.section, self.banner = words, False
            if not self.depth:
                self.banner = False
        return ("".join(said).strip().removeprefix("*").strip() if inside else None), "".join(code)

    @staticmethod
    def _c(text: str) -> bool:
        """Whether a semicolon ends a statement: what stands before it is code with brackets, braces or an equals sign, or a closing word of a declaration."""
        return bool(re.search(r"[(){}=\w]\s*;", text)) and not re.match(r"\s*(?:\.\w+|\w+:|[a-z]{3}\b)", text)


def _step(s: Scanner, row: tuple) -> str:
    """What a line tells, as text: the comment's number and its words after ``c``; number, kind, name and section of a symbol after ``s``; both with \\x1f between."""
    said, code = s.line(row.line or "")
    told = [] if said is None else [f"c{s.count}\t{said}"]
    if s.waiting and code.strip():
        s.waiting, s.doc = False, False
        if found := symbol_of(code):
            told.append(f"s{s.count}\t{found[0]}\t{found[1]}\t{s.section}")
    return "\x1f".join(told)


def doc_comments(lines: DataFrame, key: str, order: str, line: str = "line") -> DataFrame:
    """(key, comment, first, text, kind, symbol, section): the doc comments of every file, numbered from 1, with the symbol of the next line of code.

    ``lines`` has a row a line. Comments nest; ``/**`` opens a doc comment at the top only, ``;;`` lines in a row are one; marks in quotes and
    behind ``//`` mean nothing. A comment before anything but a declaration has no symbol. Banners (``/* ==``) name the section of what follows.
    Spark deals and sorts the lines; a task keeps a file's state only, never its lines.
    """
    slim = lines.select(key, F.col(order).cast("long").alias("no"), F.col(line).cast("string").alias("line"))
    told = sorted_fold(slim, [key], ["no"], Scanner, _step, "told", "string").filter("told <> ''")
    told = told.select(key, "no", F.explode(F.split("told", "\x1f")).alias("told"))
    parts = F.split("told", "\t")
    told = told.select(key, "no", F.substring("told", 1, 1).alias("what"), F.expr("cast(substring(split(told, '\t')[0], 2) as int)").alias("comment"), parts.alias("p"))
    said = told.filter("what = 'c'").groupBy(key, "comment").agg(F.min("no").alias("first"), F.array_sort(F.collect_list(F.struct("no", F.array_join(F.expr("slice(p, 2, size(p) - 1)"), "\t").alias("t")))).alias("s"))
    text = F.trim(F.array_join(F.filter(F.transform("s", lambda x: x["t"]), lambda t: t != ""), "\n"))
    named = told.filter("what = 's'").select(key, "comment", F.col("p")[1].alias("kind"), F.col("p")[2].alias("symbol"), F.col("p")[3].alias("section"))
    return said.select(key, "comment", "first", text.alias("text")).join(named, [key, "comment"], "left")
