"""Glob selection in the gitignore dialect, compiled to regular expressions.

Patterns are ordered; a leading ``!`` excludes.  The last pattern that matches a path decides;
where none does, the nearest parent that any pattern matches does.  With at least one positive
pattern unmatched paths are dropped, with only exclusions they are kept.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from sheaf.functions.paths import ancestors, is_directory, trim_slashes


@dataclass(frozen=True)
class Pattern:
    regex: str  # of a path without its trailing slash
    exclude: bool
    directories: bool  # matches directories only


@dataclass(frozen=True)
class Selection:
    """Include and exclude globs; ``patterns`` adds raw lines of the dialect."""

    lines: tuple[str, ...] = ()

    def include(self, glob: str) -> Selection:
        return Selection((*self.lines, "\\" + glob if glob[:1] in ("!", "#") else glob))

    def exclude(self, glob: str) -> Selection:
        return Selection((*self.lines, "!" + ("\\" + glob if glob[:1] in ("!", "#") else glob)))

    def patterns(self, *raw: str) -> Selection:
        return Selection((*self.lines, *raw))

    def compiled(self) -> list[Pattern]:
        return [p for p in map(compile_line, self.lines) if p]


def _trimmed(line: str) -> str:
    while line.endswith(" ") and not line.endswith("\\ "):
        line = line[:-1]
    return line


def _atom(glob: str, at: int) -> tuple[str, int]:
    """Regex of one glob element within a path component, and where the next begins."""
    c = glob[at]
    if c == "\\" and at + 1 < len(glob):
        return re.escape(glob[at + 1]), at + 2
    if c == "*":
        while at < len(glob) and glob[at] == "*":
            at += 1
        return "[^/]*", at
    if c == "?":
        return "[^/]", at + 1
    if c == "[":
        end = glob.find("]", at + 2 + (glob[at + 1 : at + 2] in ("!", "^")))
        if end > 0:
            body = glob[at + 1 : end]
            negate, body = body[:1] in ("!", "^"), body.lstrip("!^") if body[:1] in ("!", "^") else body
            return f"[{'^/' if negate else ''}{body.replace('\\', '\\\\').replace('[', '\\[')}]", end + 1
    return re.escape(c), at + 1


def glob_regex(glob: str) -> str:
    """Regex for a glob without leading ``!`` and trailing slash."""
    anchored = "/" in glob
    parts, out = glob.lstrip("/").split("/"), []
    for i, part in enumerate(parts):
        last = i == len(parts) - 1
        if part == "**":
            out.append(".*" if last and i else "(?:[^/]+/)*" if not last else ".*")
            continue
        at = 0
        while at < len(part):
            piece, at = _atom(part, at)
            out.append(piece)
        if not last:
            out.append("/")
    if len(parts) > 1 and parts[-1] == "**":
        out[-1] = ".+"
    return ("^" if anchored else "^(?:.*/)?") + "".join(out) + "$"


def compile_line(line: str) -> Pattern | None:
    """One line of the dialect; blank lines and comments are no patterns."""
    if line.startswith("#"):
        return None
    line = _trimmed(line)
    exclude = line.startswith("!")
    body = line[1:] if exclude else line
    directories = body.endswith("/") and not body.endswith("\\/")
    body = body.rstrip("/") if directories else body
    return Pattern(glob_regex(body), exclude, directories) if body.strip() else None


def _verdict(patterns: list[Pattern], path: Column, directory: Column) -> Column:
    """true keep, false drop, null no match: the last matching pattern is asked first."""
    out = None
    for p in reversed(patterns):
        hit = path.rlike(p.regex) & directory if p.directories else path.rlike(p.regex)
        out = F.when(hit, not p.exclude) if out is None else out.when(hit, not p.exclude)
    return out


def selected(path: Column, selection: Selection) -> Column:
    """Whether a normalised path is selected."""
    patterns = selection.compiled()
    if not patterns:
        return F.lit(True)
    own = _verdict(patterns, trim_slashes(path), is_directory(path))
    above = F.transform(F.reverse(ancestors(path)), lambda p: _verdict(patterns, p, F.lit(True)))
    nearest = F.get(F.filter(above, lambda v: v.isNotNull()), F.lit(0))
    return F.coalesce(own, nearest, F.lit(all(p.exclude for p in patterns)))
