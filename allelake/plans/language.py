"""The small language of filter and facet values, read into plain data.

Values joined by ',' are alternatives, values joined by ';' must all hold; the two do not mix outside quotes. A leading
'!' negates. A comparison is key, operator, value; without an operator, equality.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

AND, OR = ";", ","
OPERATORS = ("<<=", ">>=", "<<", ">>", "<=", ">=", "!=", "!~", "==", "=~", "=", "<", ">", "~")


class LanguageError(ValueError):
    """A value that the language does not allow."""


@dataclass(frozen=True)
class Terms:
    values: tuple[str, ...]
    joined_by: str | None


@dataclass(frozen=True)
class Comparison:
    key: str
    op: str
    value: str


def split(text: str, separators: str) -> list[str]:
    """Cut at the separators outside quotes; empty parts are dropped, quotes stay off."""
    parts, quoted, held = [], False, []
    for c in text:
        if c == '"':
            quoted = not quoted
        elif c in separators and not quoted:
            parts.append("".join(held))
            held = []
        else:
            held.append(c)
    if quoted:
        raise LanguageError(f"unbalanced quotes in {text!r}")
    parts.append("".join(held))
    return [p.strip() for p in parts if p.strip()]


def terms(text: str | list | tuple) -> Terms:
    if not isinstance(text, str):
        return Terms(tuple(str(x) for x in text), OR if len(text) > 1 else None)
    bare = re.sub('"[^"]*"?', "", text)
    if AND in bare and OR in bare:
        raise LanguageError(f"{AND!r} and {OR!r} cannot be mixed in {text!r}")
    joined = AND if AND in bare else OR if OR in bare else None
    return Terms(tuple(split(text, joined or "")), joined)


def negated(value: str) -> tuple[bool, str]:
    return (True, value[1:]) if value.startswith("!") else (False, value)


def same_sign(values: tuple[str, ...]) -> bool:
    """Whether a list is negated; plain and negated values do not mix."""
    signs = {v.startswith("!") for v in values}
    if len(signs) > 1:
        raise LanguageError(f"plain and negated values are mixed in {values}")
    return signs == {True}


def operator_at(text: str) -> tuple[int, str] | None:
    """Where the first operator stands, and which: the longest that starts there."""
    for i, c in enumerate(text):
        if c in "=<>~!":
            found = max((o for o in OPERATORS if text.startswith(o, i)), key=len, default=None)
            return (i, found) if found else None
    return None


def comparison(text: str) -> Comparison:
    found = operator_at(text)
    if not found or not text[found[0] + len(found[1]) :].strip():
        return Comparison("", "=", text.strip())
    at, op = found
    value = text[at + len(op) :].strip()
    if value[0] in "=<>~!":
        raise LanguageError(f"no operator: {text!r}")
    return Comparison(text[:at].strip(), op, value)


def comparisons(text: str) -> tuple[list[Comparison], str | None]:
    """All comparisons of a value; one without a key or operator takes those of the one before it."""
    found = terms(text)
    out: list[Comparison] = []
    for v in found.values:
        c = comparison(v)
        if out and not operator_at(v):
            c = Comparison(out[-1].key, out[-1].op, v)
        elif out and not c.key:
            c = Comparison(out[-1].key, c.op, c.value)
        out.append(c)
    return out, found.joined_by


def grouped(text: str) -> tuple[list[tuple[str, list[Comparison]]], str | None, str | None]:
    """'12:dp>20,gq>=10;13:dp>5' as names with their comparisons, the operator between names and the one within a name.

    What follows a name up to the next one belongs to it; a name that comes again goes on with its comparisons.
    """
    pieces, at, quoted = [("", "")], 0, False
    for i, c in enumerate(text + AND):
        quoted ^= c == '"'
        if c in (AND, OR) and not quoted:
            pieces[-1] = (pieces[-1][0], text[at:i].replace('"', "").strip())
            pieces.append((c, ""))
            at = i + 1
    groups: dict[str, list[Comparison]] = {}
    name, between, within = None, set(), set()
    for sign, piece in pieces[:-1]:
        if not piece:
            continue
        found = operator_at(piece)
        head, colon, tail = (piece[: found[0]] if found else piece).partition(":")
        if colon:
            between |= {sign} if name is not None else set()
            name, piece = head.strip(), piece[len(head) + 1 :]
        elif name is None:
            raise LanguageError(f"no name in {text!r}")
        else:
            within.add(sign)
        groups.setdefault(name, []).append(comparison(piece))
    if len(between) > 1 or len(within) > 1:
        raise LanguageError(f"{AND!r} and {OR!r} are mixed in {text!r}")
    return list(groups.items()), next(iter(between), None), next(iter(within), next(iter(between), None))


def scoped(text: str, default: str | None = None) -> tuple[str | None, str]:
    """A value with its scope: 'study:cohort' is cut at the last colon."""
    head, colon, tail = text.rpartition(":")
    return (head, tail) if colon else (default, text)


def by_key(text: str) -> tuple[dict[str, list[str]], str | None]:
    """'s1:0/1,1/1;s2:0/0' as keys with their values; a value without a key belongs to the last one."""
    joined = AND if AND in re.sub('"[^"]*"?', "", text) else OR
    out: dict[str, list[str]] = {}
    key = None
    for entry in split(text, AND) if joined == AND else [text]:
        for value in split(entry, OR):
            head, colon, tail = value.partition(":")
            if colon:
                key, value = head, tail
            if key is None:
                raise LanguageError(f"no key in {text!r}")
            out.setdefault(key, []).append(value)
    return out, joined if len(out) > 1 else None


@dataclass(frozen=True)
class Region:
    chrom: str
    start: int | None = None
    end: int | None = None


def chromosome(name: str) -> str:
    """A name without chr, chrom, chrm or ch before it."""
    return re.sub(r"^(chrom|chrm|chr|ch)(?=.)", "", name, flags=re.I)


def region(text: str) -> Region:
    m = re.fullmatch(r"([^:]+)(?::(\d+)(?:-(\d+)?)?)?", text.strip())
    if not m:
        raise LanguageError(f"no region: {text!r}")
    start = int(m[2]) if m[2] else None
    end = int(m[3]) if m[3] else (start if m[2] and "-" not in text else None)
    return Region(chromosome(m[1]), start, end)


def merged(regions: list[Region]) -> list[Region]:
    """Overlapping and touching regions of a chromosome become one."""
    out: list[Region] = []
    for r in sorted(regions, key=lambda r: (r.chrom, r.start or 0)):
        last = out[-1] if out else None
        if last and last.chrom == r.chrom and (last.end is None or (r.start or 0) <= last.end + 1):
            end = None if last.end is None or r.end is None else max(last.end, r.end)
            out[-1] = Region(r.chrom, last.start, end)
        else:
            out.append(r)
    return out


@dataclass(frozen=True)
class Facet:
    """One level of a facet: a field, an aggregation over it or none, values to include, or a range with a step; a limit."""

    name: str
    function: str | None = None
    include: tuple[str, ...] = ()
    low: float | None = None
    high: float | None = None
    step: float | None = None
    limit: int | None = None
    inner: tuple[Facet, ...] = field(default=())


_FACET = re.compile(r"^(?:(\w+)\(([\w.]+)\)|([\w.]+))(?:\[([^\]]*)\])?(?::(\d+(?:\.\d+)?))?$")
_RANGE = re.compile(r"^(-?[\d.]+)\.\.(-?[\d.]+)$")


def facet_level(text: str) -> Facet:
    m = _FACET.match(text.strip())
    if not m:
        raise LanguageError(f"no facet: {text!r}")
    name, number = m[2] or m[3], float(m[5]) if m[5] else None
    if m[4] and (r := _RANGE.match(m[4])):
        if number is None:
            raise LanguageError(f"a range needs a step: {text!r}")
        return Facet(name, m[1], (), float(r[1]), float(r[2]), number)
    include = tuple(split(m[4], OR)) if m[4] else ()
    return Facet(name, m[1], include, limit=int(number) if number is not None else None)


def facets(text: str) -> list[list[Facet]]:
    """Facets are joined by ';', their levels by '>>'."""
    return [[facet_level(x) for x in part.split(">>")] for part in split(text, AND)]
