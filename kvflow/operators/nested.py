"""Flat, linked rows from deeply nested JSON documents, by structural indexing of whole Arrow batches.

The bodies of a batch are one byte array. Vectorised passes build the bitmaps of quotes (without escaped ones), of text in
quotes, of brackets and of delimiters; prefix sums over the brackets give the depth of every byte. All members of all
containers of one depth are then found at once, as the spans between its delimiters, and are linked with their container by
the place of its bracket. Depths 1 to 3 hold all that is wanted of a document.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kvflow.session import parallel

#: List and the field of its elements that becomes val; None: the elements are lists of scalars.
CHECKPOINT_LISTS: dict[str, str | None] = {"map_tasks": "state", "reduce_tasks": "state", "decisions": "type", "map_done_for_reduce": None}
#: Bytes of text indexed at a time; one document may exceed it.
BLOCK_BYTES = 1 << 20
OPEN, CLOSE = np.zeros(256, bool), np.zeros(256, bool)
OPEN[[ord("{"), ord("[")]] = True
CLOSE[[ord("}"), ord("]")]] = True


SPACE = np.zeros(256, bool)
SPACE[list(b" \t\n\r\x0b\x0c")] = True
#: How scalars of a list of scalars read.
TRUTH = {"1": "true", "0": "false"}


@dataclass
class Members:
    """All members of all containers of one depth, in order: the bracket of their container, the span of their name (empty
    without one), their own span, and their position in the container."""

    container: np.ndarray
    name: np.ndarray
    name_end: np.ndarray
    start: np.ndarray
    end: np.ndarray
    rank: np.ndarray

    def within(self, brackets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(number of the member, number of its bracket) for the members of the containers with these brackets."""
        if not len(brackets):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        order = np.argsort(brackets, kind="stable")
        at = np.minimum(np.searchsorted(brackets[order], self.container), len(brackets) - 1)
        hit = np.flatnonzero(brackets[order][at] == self.container)
        return hit, order[at[hit]]


class Index:
    """Structural index of one or more documents that lie behind each other in `data`, each beginning at one of `starts`."""

    def __init__(self, data: bytes, starts: np.ndarray):
        self.data = data
        self.bytes = b = np.frombuffer(data, np.uint8)
        n = len(b)
        starts = starts[starts < n]
        slash = b == 0x5C
        # A byte is escaped if an odd run of backslashes ends before it.
        place = np.arange(n)
        run = place - np.maximum.accumulate(np.where(slash, -1, place)) if n else place
        escaped = np.zeros(n, bool)
        escaped[1:] = run[:-1] % 2 == 1
        quote = (b == 0x22) & ~escaped
        count = np.cumsum(quote)
        before = count - quote
        first = np.zeros(n, bool)
        first[starts] = True
        # Quotes are counted from the start of each document, so an unclosed one ends with its document.
        base = np.repeat(before[starts], np.diff(np.append(starts, n))) if n else before
        inside = ((before - base) % 2 == 1) & ~quote
        opens, closes = OPEN[b] & ~inside & ~quote, CLOSE[b] & ~inside & ~quote
        level = np.cumsum(opens.astype(np.int32) - closes)
        shift = np.repeat((level - opens + closes)[starts], np.diff(np.append(starts, n))) if n else level
        #: Depth of the content around each byte: an opening bracket belongs to the outer level, as does its closing one.
        self.depth = level - shift - opens
        structural = opens | closes | ((b == 0x2C) | (b == 0x3A)) & ~inside & ~quote
        self.places = np.flatnonzero(structural)
        self.kinds = b[self.places]
        self.levels = self.depth[self.places]
        self.odd = (count - base) % 2 == 1

    def document(self, start: int, end: int) -> tuple[int, int] | None:
        """Range of structural places of the document, or None if it is no complete object or list."""
        lo, hi = np.searchsorted(self.places, (start, end))
        if lo == hi or self.odd[end - 1] or self.places[lo] != start or self.places[hi - 1] != end - 1:
            return None
        levels = self.levels[lo:hi]
        kinds = self.kinds[lo:hi]
        if levels[0] != 0 or levels[-1] != 0 or (levels[1:-1] < 1).any():
            return None
        # Brackets of one level alternate, and each pair must be of one kind.
        brackets = np.flatnonzero(OPEN[kinds] | CLOSE[kinds])
        order = brackets[np.argsort(levels[brackets], kind="stable")]
        opening, closing = kinds[order[::2]], kinds[order[1::2]]
        if len(opening) != len(closing) or not OPEN[opening].all() or (closing - opening != 2).any():
            return None
        return int(lo), int(hi)

    def children(self, lo: int, hi: int) -> list[tuple[bytes | None, int, int, int, int]]:
        """(name or None, start, end, lo, hi) of each member of the container whose brackets are at places lo and hi - 1."""
        level = self.levels[lo] + 1
        inner = lo + 1 + np.flatnonzero(self.levels[lo + 1 : hi - 1] == level)
        kinds = self.kinds[inner]
        named = self.kinds[lo] == 0x7B
        cuts = inner[kinds == 0x2C].tolist()
        colons = inner[kinds == 0x3A].tolist()
        out, colon = [], 0
        begin = lo
        for end in [*cuts, hi - 1]:
            first, last = int(self.places[begin]) + 1, int(self.places[end])
            name = None
            if named:
                while colon < len(colons) and colons[colon] < begin:
                    colon += 1
                if colon < len(colons) and colons[colon] < end:
                    at = int(self.places[colons[colon]])
                    name, first = self.data[first:at].strip(), at + 1
                    begin = colons[colon]
            text = self.data[first:last]
            if text.strip():
                out.append((name, first + len(text) - len(text.lstrip()), first + len(text.rstrip()), begin + 1, end))
            begin = end
        return out

    def members(self, depth: int, valid: np.ndarray) -> Members:
        """Members at a depth (1: those of the documents themselves) among the structural places that are valid."""
        bracket = OPEN[self.kinds] | CLOSE[self.kinds]
        own = valid & np.where(bracket, self.levels == depth - 1, self.levels == depth)
        at, kinds = self.places[own], self.kinds[own]
        number = np.arange(len(at))
        opens, commas = OPEN[kinds], kinds == 0x2C
        # Containers of one depth do not overlap, so their delimiters lie behind each other.
        ends = np.flatnonzero(commas | CLOSE[kinds])
        begin = np.maximum.accumulate(np.where(opens | commas, number, 0))[ends - 1]
        bracket_at = np.maximum.accumulate(np.where(opens, number, 0))[ends]
        named = (kinds[bracket_at] == 0x7B) & (kinds[begin + 1] == 0x3A)
        start = self._after(at[begin + named] + 1)
        end = at[ends]
        kept = start < end
        container, end = at[bracket_at][kept], self._before(end[kept])
        name = self._after(at[begin][kept] + 1)
        name_end = np.where(named[kept], self._before(at[begin + named][kept]), name)
        first = np.flatnonzero(np.append(True, container[1:] != container[:-1])) if len(container) else np.zeros(0, np.int64)
        rank = np.arange(len(container)) - np.repeat(first, np.diff(np.append(first, len(container))))
        return Members(container, name, np.maximum(name_end, name), start[kept], end, rank)

    def _after(self, at: np.ndarray) -> np.ndarray:
        """The next byte from each place on that is no white space."""
        at = at.copy()
        while len(here := np.flatnonzero(SPACE[self.bytes[np.minimum(at, len(self.bytes) - 1)]] & (at < len(self.bytes)))):
            at[here] += 1
        return at

    def _before(self, end: np.ndarray) -> np.ndarray:
        """Each end without the white space before it."""
        end = end.copy()
        while len(here := np.flatnonzero(SPACE[self.bytes[end - 1]])):
            end[here] -= 1
        return end

    def says(self, start: np.ndarray, end: np.ndarray, word: bytes) -> np.ndarray:
        """Which spans are exactly this word."""
        hit = np.flatnonzero(end - start == len(word))
        for i, byte in enumerate(word):
            hit = hit[self.bytes[start[hit] + i] == byte]
        out = np.zeros(len(start), bool)
        out[hit] = True
        return out

    def kind(self, start: int) -> str:
        return self.data[start : start + 1].decode("latin-1")


def _text(raw: bytes) -> str:
    """A scalar's text: strings without quotes and escapes, everything else as written."""
    if raw[:1] == b'"':
        if b"\\" not in raw:
            return raw[1:-1].decode("utf-8", "replace")
        try:
            return json.loads(raw, strict=False)
        except ValueError:
            return raw[1:-1].decode("utf-8", "replace")
    return raw.decode("utf-8", "replace")


def _name(raw: bytes | None) -> str | None:
    return None if raw is None else _text(raw)


def _elements(index: Index, start: int, end: int, lo: int, hi: int) -> Iterator[tuple[int, int, int, int, int]]:
    """(position, start, end, lo, hi) of a list's elements; an object is a list of one unless its names are numbers."""
    kind = index.kind(start)
    if kind == "[":
        for i, (_, *span) in enumerate(index.children(lo, hi)):
            yield i, *span
    elif kind == "{":
        members = index.children(lo, hi)
        names = [_name(m[0]) for m in members]
        if all(n is not None and n.isascii() and n.isdigit() for n in names):
            last = {int(n): m for n, m in zip(names, members, strict=True)}
            for i, (_, *span) in last.items():
                yield i, *span
        else:
            yield 0, start, end, lo, hi


def _texts(index: Index, start: np.ndarray, end: np.ndarray) -> list[str]:
    data = index.data
    return [_text(data[a:b]) for a, b in zip(start.tolist(), end.tolist(), strict=True)]


Rows = tuple[np.ndarray, str, np.ndarray, np.ndarray, list[str]]


def _rows(index: Index, documents: list[tuple[int, int]], lists: dict[str, str | None]) -> Iterator[Rows]:
    """(number of the document, child, idx, sub_idx, val) columns of all elements of the lists of the documents."""
    valid = np.zeros(len(index.places), bool)
    roots = []
    for i, (start, end) in enumerate(documents):
        found = index.document(start, end) if end > start and index.kind(start) == "{" else None
        if found:
            valid[found[0] : found[1]] = True
            roots.append((start, i))
    if not roots:
        return
    top, second, third = (index.members(depth, valid) for depth in (1, 2, 3))
    places, numbers = np.array(roots).T
    hit, at = top.within(places)
    # Of a name given twice the last counts.
    chosen: dict[str, dict[int, int]] = {child: {} for child in lists}
    for m, owner, a, b in zip(hit.tolist(), numbers[at].tolist(), top.name[hit].tolist(), top.name_end[hit].tolist(), strict=True):
        name = _text(index.data[a:b])
        if name in chosen:
            chosen[name][owner] = m
    for child, field in lists.items():
        owners = np.array(list(chosen[child]), np.int64)
        value = np.array(list(chosen[child].values()), np.int64)
        start, end = top.start[value], top.end[value]
        hit, at = second.within(start[index.bytes[start] == 0x5B])
        elements = [(owners[index.bytes[start] == 0x5B][at], second.rank[hit], second.start[hit], second.end[hit])]
        # Objects in place of a list: one by one.
        for owner, a, b in zip(*(x[index.bytes[start] == 0x7B].tolist() for x in (owners, start, end)), strict=True):
            single = [e[:3] for e in _elements(index, a, b, *np.searchsorted(index.places, (a, b)).tolist())]
            if single:
                position, a2, b2 = (np.array(x, np.int64) for x in zip(*single, strict=True))
                elements.append((np.full(len(single), owner), position, a2, b2))
        owner, idx, start, end = (np.concatenate(x) for x in zip(*elements, strict=True))
        there = ~index.says(start, end, b"null")
        owner, idx, start, end = owner[there], idx[there], start[there], end[there]
        first = index.bytes[start]
        if field is not None:
            values = np.full(len(start), "", object)
            objects = np.flatnonzero(first == 0x7B)
            for members in (third, second):  # an object in place of a list has its fields one level higher
                hit, at = members.within(start[objects])
                fits = index.says(members.name[hit], members.name_end[hit], json.dumps(field).encode())
                for i in np.flatnonzero(~fits & (members.name_end[hit] - members.name[hit] > len(field) + 2)).tolist():
                    raw = index.data[members.name[hit[i]] : members.name_end[hit[i]]]
                    fits[i] = b"\\" in raw and _text(raw) == field
                hit, at = hit[fits], at[fits]
                null = index.says(members.start[hit], members.end[hit], b"null")
                found = np.array(_texts(index, members.start[hit], members.end[hit]), object)
                found[null] = ""
                values[objects[at]] = found
            yield owner, child, idx, np.full(len(idx), -1), values.tolist()
            continue
        hit, at = third.within(start[first == 0x5B])
        cells = [(owner[first == 0x5B][at], idx[first == 0x5B][at], third.rank[hit], third.start[hit], third.end[hit])]
        for i in np.flatnonzero(first == 0x7B).tolist():
            a, b = int(start[i]), int(end[i])
            for j, a2, b2, *_ in _elements(index, a, b, *np.searchsorted(index.places, (a, b)).tolist()):
                cells.append(tuple(np.array([x]) for x in (owner[i], idx[i], j, a2, b2)))
        owner, idx, sub, start, end = (np.concatenate(x) for x in zip(*cells, strict=True))
        values = [TRUTH.get(t, t) for t in _texts(index, start, end)]
        there = np.array([v != "null" for v in values], bool)
        yield owner[there], child, idx[there], sub[there], [v for v in values if v != "null"]


def _unwrapped(body: str | None) -> bytes:
    """The document without byte order mark and outer white space; one that was stored as a JSON string is decoded."""
    text = (body or "").strip("﻿ \t\r\n")
    for _ in range(4):
        if not (len(text) > 1 and text[0] == text[-1] == '"'):
            break
        try:
            text = json.loads(text, strict=False).strip("﻿ \t\r\n")
        except ValueError:
            return b""
    return text.encode("utf-8", "replace")


def flatten_lists(df: DataFrame, key: str, body: str, lists: dict[str, str | None]) -> DataFrame:
    """(key, child, idx INT, sub_idx INT, val STRING): one row per element of the lists at the top of each document.

    * idx is the position in the list from 0, sub_idx that in an inner list, otherwise -1. Null elements keep their place
      but give no row. A list given as one object is a list of one; as an object whose names are numbers, the number is idx.
    * val is the named field of the element, '' if it is absent or null; of scalars their text, with 1 and 0 as true and false.
    * A null or empty body, or one that holds no complete object, gives no rows; a name given twice counts as last given.
    * Rows with the same key each give their own rows. Other columns are not read.
    """
    kind = df.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, bodies = batch.column(0), batch.column(1).to_pylist()
            at = 0
            while at < len(bodies):
                parts, size, first = [], 0, at
                while at < len(bodies) and (size < BLOCK_BYTES or at == first):
                    parts.append(_unwrapped(bodies[at]))
                    size += len(parts[-1]) + 1
                    at += 1
                lengths = np.array([len(p) + 1 for p in parts])
                starts = np.cumsum(lengths) - lengths
                index = Index(b"\n".join(parts) + b"\n", starts)
                spans = [(int(a), int(a) + len(p)) for a, p in zip(starts, parts, strict=True)]
                for owner, child, idx, sub, val in _rows(index, spans, lists):
                    if len(owner):
                        columns = [keys.take(pa.array(owner + first)), pa.array([child]).take(pa.array(np.zeros(len(owner), np.int32)))]
                        columns += [pa.array(idx, pa.int32()), pa.array(sub, pa.int32()), pa.array(val, pa.string())]
                        yield pa.RecordBatch.from_arrays(columns, names=[key, "child", "idx", "sub_idx", "val"])

    return parallel(df.select(F.col(key), F.col(body))).mapInArrow(run, f"`{key}` {kind}, child string, idx int, sub_idx int, val string")
