"""Strict RFC 4180 files: one malformed row fails the file."""

from __future__ import annotations

import re


class Malformed(ValueError):
    pass


#: One field and what ends it. A quoted field may hold anything, with its quotes doubled; a plain one holds no quote.
FIELD = re.compile(r'(?:"((?:[^"]|"")*)"|([^",\r\n]*))(,|\r\n|\r|\n|\Z)')


def rows(text: str) -> list[list[str]]:
    """All records, the header among them; CR, LF and CRLF end a record, blank lines are skipped."""
    out: list[list[str]] = []
    record: list[str] = []
    at, n = 0, len(text)
    while at < n or record:
        found = FIELD.match(text, at)
        if not found:
            raise Malformed(f"stray or unclosed quote after record {len(out)}")
        quoted, plain, end = found.groups()
        blank = not record and quoted is None and plain == "" and end != ","
        if not blank:
            record.append(plain if quoted is None else quoted.replace('""', '"'))
        at = found.end()
        if end != ",":
            if record:
                out.append(record)
            record = []
            if at >= n:
                break
    return out


def documents(text: str) -> list[str]:
    """Each data record's fields joined by single spaces. The header fixes the number of fields.

    Raises Malformed for an empty file, an unclosed or stray quote, or a record of another width.
    """
    records = rows(text)
    if not records:
        raise Malformed("no header")
    width = len(records[0])
    for i, r in enumerate(records):
        if len(r) != width:
            raise Malformed(f"record {i} has {len(r)} fields, the header {width}")
    return [" ".join(r) for r in records[1:]]
