"""A Spark data source for simulator decks: one row a record, in deck order.

A deck is a file of keywords with records that end at ``/``. Comments start with ``--``;
includes are read in place; ``n*v`` is v n times and ``n*`` n defaults (null). A partition
is one deck with its includes, because order is data. ``.gz`` files and files in UTF-8
or CP1251 are read.
"""

from __future__ import annotations

import gzip
import re
from collections.abc import Iterator
from dataclasses import dataclass

from pyarrow import fs
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

SCHEMA = "path string, seq long, section string, keyword string, record_no int, line_no int, tokens array<string>"
SECTIONS = ("RUNSPEC", "GRID", "EDIT", "PROPS", "REGIONS", "SOLUTION", "SUMMARY", "SCHEDULE")
#: Keywords with many records, up to one that is empty.
LISTS = frozenset(
    "WELSPECS WELSPECL COMPDAT COMPDATL COMPDATMD WCONPROD WCONINJE WCONHIST WCONINJH WELOPEN WEFAC WFRAC WFRACP "
    "GRUPTREE GCONPROD COPY EQUALS MULTIPLY ADD DATES FAULTS MULTFLT AQUANCON WTEST WELTARG GROUP".split()
)
#: Keywords whose groups end at ``/`` and whose tables end at an empty record.
NESTED = frozenset(("PVTO", "PVTG"))
TEXT_LINE = frozenset(("TITLE",))
SKIP_TO_SLASH = frozenset(("ARITHMETIC", "RPTSCHED", "RPTSOL", "RPTRST", "RPTGRID", "RPTPROPS", "RPTREGS"))
_TOKEN = re.compile(r"'[^']*'|\"[^\"]*\"|/|[^\s/'\"]+")
_KEYWORD = re.compile(r"[A-Z][A-Z0-9_+-]*$")
_REPEAT = re.compile(r"(\d+)\*(.*)$")


def expand(tokens: list[str]) -> list[str | None]:
    """Repeat counts written out; names without their quotes."""
    out: list[str | None] = []
    for t in tokens:
        if t[0] in "'\"":
            out.append(t.strip("'\"").strip())
        elif m := _REPEAT.match(t):
            out += [m[2] or None] * int(m[1])
        else:
            out.append(t)
    return out


def decode(raw: bytes) -> str:
    try:
        return raw.decode("utf-8")
    except UnicodeDecodeError:
        return raw.decode("cp1251")


class Files:
    """Reads files of a store; names match whatever their case, and with ``.gz`` added."""

    def __init__(self, path: str) -> None:
        self.store, self.root = fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)

    def _find(self, path: str) -> str | None:
        for p in (path, f"{path}.gz"):
            if self.store.get_file_info(p).type == fs.FileType.File:
                return p
        folder, _, name = path.rpartition("/")
        found = self.store.get_file_info(fs.FileSelector(folder or ".", allow_not_found=True))
        return next((f.path for f in sorted(found, key=lambda f: f.path) if f.base_name.lower() in (name.lower(), f"{name.lower()}.gz")), None)

    def lines(self, path: str) -> list[str] | None:
        at = self._find(path)
        if at is None:
            return None
        with self.store.open_input_stream(at, compression=None) as f:
            raw = f.read()
        return decode(gzip.decompress(raw) if at.endswith(".gz") else raw).splitlines()


def records(files: Files, path: str, missing: str = "error", seen: tuple[str, ...] = ()) -> Iterator[tuple[str, str, int, int, list[str | None]]]:
    """(section, keyword, record number, line number, tokens) of a deck and its includes."""
    lines = files.lines(path)
    if lines is None:
        if missing == "skip":
            return
        raise FileNotFoundError(path)
    if path in seen:
        raise ValueError(f"{path} includes itself")
    section, keyword, number, held, ended, text = "", None, 0, [], True, False
    for n, line in enumerate(lines, 1):
        bare = line.split("--")[0] if "'" not in line.split("--")[0] or line.split("--")[0].count("'") % 2 == 0 else line
        if text:
            yield section, keyword, 0, n, [bare.strip()]
            text, ended, keyword = False, True, None
            continue
        tokens = _TOKEN.findall(bare)
        if not tokens:
            continue
        head = tokens[0].upper()
        fresh = not held and (ended or keyword is None)
        if fresh and _KEYWORD.match(head) and head != "/":
            keyword, number, ended = head, 0, False
            if head in SECTIONS:
                section, ended = head, True
            text = head in TEXT_LINE
            yield section, head, -1, n, []
            if head == "END":
                return
            tokens = tokens[1:]
        elif not held and keyword is not None and keyword not in LISTS and number == 0 and _KEYWORD.match(head) and len(tokens) == 1:
            keyword, number, ended = head, 0, False  # the keyword before had no data
            if head in SECTIONS:
                section, ended = head, True
            text = head in TEXT_LINE
            yield section, head, -1, n, []
            if head == "END":
                return
            continue
        for t in tokens:
            if t != "/":
                held.append(t)
                continue
            if keyword == "INCLUDE" and held:
                name = held[0].strip("'\"")
                at = name if name.startswith("/") else f"{path.rpartition('/')[0]}/{name}"
                for s, k, r, ln, tok in records(files, at, missing, (*seen, path)):
                    yield s or section, k, r, ln, tok
            elif held or keyword not in LISTS | NESTED:
                if keyword not in SKIP_TO_SLASH:
                    yield section, keyword, number, n, expand(held)
                number += 1
            ended = keyword not in LISTS | NESTED or not held
            held = []
            break  # what follows a slash is comment
    if held:
        yield section, keyword, number, len(lines), expand(held)


@dataclass
class Deck(InputPartition):
    path: str

    def __init__(self, path: str) -> None:
        self.path = path


class DeckReader(DataSourceReader):
    def __init__(self, options: dict) -> None:
        self.paths, self.missing = options["path"].split(","), options.get("missing", "error")

    def partitions(self) -> list[Deck]:
        return [Deck(p) for p in self.paths]

    def read(self, partition: Deck) -> Iterator[tuple]:
        files = Files(partition.path)
        for seq, (section, keyword, number, line, tokens) in enumerate(records(files, files.root, self.missing)):
            yield partition.path, seq, section, keyword, number, line, tokens


class DeckSource(DataSource):
    """``format("deck")``: ``path`` (several by comma), ``missing`` (error or skip). A keyword's own row has record_no -1."""

    @classmethod
    def name(cls) -> str:
        return "deck"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DeckReader:
        return DeckReader(self.options)
