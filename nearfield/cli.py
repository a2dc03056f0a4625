"""Command-line arguments of extraction and index building, and where dumps lie. Nothing is fetched."""

from __future__ import annotations

from dataclasses import dataclass

from nearfield.constants import DUMP_TABLES, LANGUAGES
from nearfield.operators.extract import parse_box


@dataclass
class Options:
    lang: str = LANGUAGES[0]
    limit: int | None = None
    bounds: dict | None = None


def dump_path(lang: str, table: str, folder: str = "data/dumps") -> str:
    """The path of a language's dump of one table."""
    if lang not in LANGUAGES or table not in DUMP_TABLES:
        raise ValueError(f"no dump of table {table} for language {lang}")
    return f"{folder}/{lang}wiki-latest-{table}.sql.gz"


def parsed(arguments: list[str]) -> Options:
    """Options of ``--limit=n``, ``--bounds=west,south,east,north`` and ``--lang=xx``; other flags are ignored. ValueError for a
    limit that is no positive whole number, bounds that are no four numbers, or a language that isn't supported."""
    out = Options()
    for argument in arguments:
        name, _, value = argument.partition("=")
        if name == "--limit":
            if not value.isdecimal() or int(value) < 1:
                raise ValueError(f"invalid limit: {value}")
            out.limit = int(value)
        elif name == "--bounds":
            out.bounds = parse_box(value)
        elif name == "--lang":
            if value not in LANGUAGES:
                raise ValueError(f"unsupported language {value}; supported: {', '.join(LANGUAGES)}")
            out.lang = value
    return out
