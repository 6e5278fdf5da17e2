"""Locations of flat files: nested join, order and complement, single bases, sites between bases, open ends, other records.

A location is a list of parts in the order in which they are read, each with its own strand.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, replace

_TOKEN = re.compile(r"\s*(?:(?P<op>join|order|bond|complement)\s*\(|(?P<remote>[\w.\-]+):|(?P<low>[<>]?\d+)(?:\s*(?P<between>\.\.|\.|\^)\s*(?P<high>[<>]?\d+))?|(?P<mark>[(),]))")


@dataclass(frozen=True)
class Part:
    """Bases start to end (0-based, inclusive) of a strand; `between`: the site between two neighbouring bases; remote: another record's."""

    start: int
    end: int
    strand: int = 1
    remote: str | None = None
    between: bool = False
    open_start: bool = False
    open_end: bool = False

    def bases(self) -> bool:
        return self.remote is None and not self.between


def parse(text: str) -> list[Part]:
    """The parts of a location; ValueError where the text is none."""
    held: list[tuple[str, list[Part]]] = [("", [])]
    at, remote, text = 0, None, text.strip()
    while at < len(text):
        m = _TOKEN.match(text, at)
        if not m:
            raise ValueError(f"no location: {text!r}")
        at = m.end()
        if m["op"]:
            held.append((m["op"], []))
        elif m["remote"]:
            remote = m["remote"]
        elif m["low"]:
            held[-1][1].append(_part(m, remote))
            remote = None
        elif m["mark"] == ")":
            if len(held) == 1:
                raise ValueError(f"unbalanced: {text!r}")
            op, parts = held.pop()
            held[-1][1].extend([replace(p, strand=-p.strand) for p in reversed(parts)] if op == "complement" else parts)
        elif m["mark"] == "(":
            held.append(("", []))
    if len(held) != 1:
        raise ValueError(f"unbalanced: {text!r}")
    return held[0][1]


def _part(m: re.Match, remote: str | None) -> Part:
    low, high = m["low"], m["high"] or m["low"]
    number = lambda x: int(x.lstrip("<>")) - 1
    return Part(number(low), number(high), 1, remote, m["between"] == "^", low[0] in "<>", m["high"] is not None and high[0] in "<>")


def _written(p: Part) -> str:
    low, high = f"{'<' * p.open_start}{p.start + 1}", f"{'>' * p.open_end}{p.end + 1}"
    span = f"{low}^{high}" if p.between else low if p.start == p.end and not p.open_end else f"{low}..{high}"
    return f"{p.remote}:{span}" if p.remote else span


def write(parts: list[Part]) -> str:
    """A location of the parts: parse() gives the same parts."""
    if parts and all(p.strand == -1 for p in parts):
        return f"complement({write([replace(p, strand=1) for p in reversed(parts)])})"
    texts = [f"complement({_written(p)})" if p.strand == -1 else _written(p) for p in parts]
    return f"join({','.join(texts)})" if len(texts) > 1 else "".join(texts)


def strand_of(parts: list[Part]) -> int:
    """-1 if all parts are on the other strand, else 1."""
    return -1 if parts and all(p.strand == -1 for p in parts) else 1


def spans(parts: list[Part]) -> list[tuple[int, int]]:
    """The record's own bases as they follow on the strand that is written; a lone site between bases counts as its two bases."""
    own = [(p.start, p.end) for p in parts if p.bases()] or [(p.start, p.end) for p in parts if p.remote is None]
    return own[::-1] if strand_of(parts) == -1 else own
