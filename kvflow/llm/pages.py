"""The main body of web pages, by wrappers inferred for each site.

A page is read as a stream of blocks: runs of text between block-level tags, each with the path of its elements and a shape
(only links, a path of links, short lines, or plain). Blocks of a shape that no running text has, and headings of side boxes,
buttons and scripts are landmarks. As in union-free regular-expression inference, the streams of a site are aligned one
after the other: equal landmarks are template, repeated ones fold into a repeated group, landmarks that some pages lack
become optional, and what lies between two landmarks is a slot of text blocks. The slot that holds most of the site's
running text is the body; texts that recur on pages with different content are template text wherever they stand. A landmark
that stands among paragraphs of its own kind (a linked paragraph, a small subheading) is judged as these are.

Each page is parsed once, into a table of its stream and blocks. All that follows are joins and sums over that table: of a
site its streams, kinds of block and recurring texts are counted before any shuffle, wrappers are inferred from ranges of a
site's streams and then merged, and each stream is placed in the merged wrapper by itself, so no task holds a whole site.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections import Counter, defaultdict
from collections.abc import Callable, Iterable, Iterator, Sequence
from concurrent.futures import ThreadPoolExecutor
from itertools import pairwise

import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.util import inheritable_thread_target

from kvflow.session import bounded, discard, materialise, parallel

# How pieces are cut, as the result's definition has it; the elements of HTML by their role.
CUT = re.compile(r"(<[^>]*>)")
BLANKS = re.compile(r"[\t\n\f\r ]+")
SPACES = "\t\n\f\r "
BLOCKS = frozenset(
    "html head body title style script noscript nav main article section aside header footer div p ul ol li dl dt dd table thead tbody tfoot tr td th "
    "h1 h2 h3 h4 h5 h6 blockquote pre form fieldset figure figcaption button select textarea iframe center address details summary dialog".split()
)
VOID = frozenset("br img hr meta link input area base col embed source track wbr".split())
RAW = frozenset("script style textarea iframe noscript".split())
CLOSES_P = BLOCKS - frozenset("button select html head body title style script td th tr tbody thead tfoot li dt dd noscript textarea".split())
SUBHEADINGS = frozenset("h4 h5 h6".split())
SIDE = SUBHEADINGS | frozenset("button select".split())
#: Elements that show nothing or are no part of the layout.
HIDDEN = frozenset("script style title noscript textarea iframe comment".split())
SCOPES = frozenset("td th table div article main aside nav section body".split())
LIST_ITEMS = frozenset("li td th dt dd".split())
CRUMBS = re.compile(r"»|›|&raquo;|&rsaquo;")
ENDS = frozenset(".!?。！？…")
QUOTES = frozenset("\"'”’»)")
HEADINGS = frozenset("h1 h2 h3".split())
NEVER_TEMPLATE = LIST_ITEMS | HEADINGS
SENTENCE = re.compile(r"""[.!?。！？…]["'”’»)]*$""")
STOPS = re.compile(r"[.!?。！？]+")
NAME = re.compile(r"</?([a-zA-Z][a-zA-Z0-9]*)")
ATTRIBUTE = re.compile(r"""\b(class|id|role|width|colspan)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+))""", re.I)
WORDS = re.compile(r"[㐀-鿿]|\w+")
#: Numbers of records in classes and ids (post-4711), which differ from page to page. Generated names are a site's own and stay.
SERIAL = re.compile(r"(?<![a-z0-9])[0-9]{3,}(?![a-z0-9])")

#: Texts of more words tell a page's content.
SHORT_WORDS = 30
#: A block of so many words is running text.
RUNNING_WORDS = 6
#: So many of its words count when slots are weighed, so that no single page decides for a site.
COUNTED_WORDS = 60
#: A box with a button is a notice up to so many words.
NOTICE_WORDS = 80
#: A text is template if it stands on pages of so many different contents of its site, and on this share of them ...
TEMPLATE_PAGES = 4
TEMPLATE_SHARE = 0.01
#: ... or on pages of so many sites, with TEMPLATE_PAGES contents on each on average.
TEMPLATE_SITES = 6
#: A kind of block is template if this share of its blocks has template texts and it runs to few words on average, ...
TEMPLATE_BLOCKS = 0.5
TEMPLATE_WORDS = 12
#: ... or if this share has, whatever its length.
TEMPLATE_NEARLY_ALL = 0.9
#: Streams of this share of a site's blocks are its usual ones; a slot with this share of the fullest one's running text is body.
USUAL_SHARE = 0.02
BODY_SHARE = 0.25
#: A landmark is rare on a site if the share of the site's blocks in streams with it is less than this part of the largest share on any site.
FOREIGN_SHARE = 0.1
#: A stream is foreign to a site if more than this part of its landmarks is rare there.
FOREIGN_MARKS = 0.5
#: A landmark on a smaller share of a site's blocks, or on fewer pages, is no part of the site's wrapper, which bounds the
#: wrapper's length.
WRAPPER_SHARE = 0.001
WRAPPER_PAGES = 2
#: Body cells and template texts, 8 bytes each, up to which they are broadcast; more are joined by shuffle.
BROADCAST_KEYS = 1_000_000
_tags: dict[str, tuple[str, str, str]] = {}
_marks: dict[tuple[str, str, str], str] = {}


def site(url: Column) -> Column:
    """The host without port and the prefixes www. and m.; '' where the URL has none."""
    host = F.regexp_extract(F.lower(url), r"^\s*(?:[a-z][a-z0-9+.\-]*:)?//(?:[^/?#@]*@)?([^/?#:]*)", 1)
    return F.coalesce(F.regexp_replace(host, r"^(?:(?:www|m)\.)+", ""), F.lit(""))


def _tag(tag: str) -> tuple[str, str, str]:
    """(what, name, key) of a tag: what is open, close, void, inline, end (of an inline element), comment or none."""
    if tag.startswith("<!--"):
        return "comment", "", ""
    known = _tags.get(tag)
    if known:
        return known
    found = NAME.match(tag)
    name = found[1].lower() if found else ""
    key = name
    if not found:
        what = "none"
    elif name in VOID:
        what = "void"
    elif name in BLOCKS:
        what = "close" if tag[1] == "/" else "open"
        if name != "body" and name != "html" and "=" in tag:
            for attribute, *values in ATTRIBUTE.findall(tag):
                attribute, value = attribute.lower(), "".join(values).strip().lower()
                key += {"class": ".", "id": "#", "role": "@"}.get(attribute, ":") + (SERIAL.sub("0", value) if attribute in ("class", "id") else value)
    else:
        what = "end" if tag[1] == "/" else "inline"
        key = "s" if name == "span" and "class" not in tag.lower() else name
    if len(_tags) > 50_000:
        _tags.clear()
    _tags[tag] = (what, name, key)
    return _tags[tag]


class Block:
    __slots__ = ("breaks", "cell", "chain", "ended", "hidden", "key", "linked", "mark", "parts", "path", "pieces", "running", "shown", "spanned", "tail", "text", "words")

    def __init__(self, path: str, tail: str, chain: tuple[int, ...]):
        self.path, self.tail, self.chain = path, tail, chain
        self.pieces: list[int] = []
        self.parts: list[str] = []
        self.words = self.linked = self.spanned = self.shown = self.ended = self.breaks = 0


def pieces(html: str) -> list[str]:
    """All pieces of a page, by number."""
    cut = (BLANKS.sub(" ", t).strip(" ") for t in CUT.split(html)[::2])
    return [t for t in cut if t]


def _count(text: str) -> int:
    """Words of a piece; Han characters count as words, signs alone do not."""
    if text.isascii():
        return len(text.split()) if len(text) > 3 or any(map(str.isalnum, text)) else 0
    return len(WORDS.findall(text))


def blocks(html: str) -> list[Block]:
    """The blocks of a page in order; every piece belongs to exactly one."""
    out: list[Block] = []
    #: Name, path and number of each open block element.
    stack: list[tuple[str, str, int]] = []
    current: Block | None = None
    raw = ""
    comment = False
    links = spans = number = serial = 0
    known = _tags.get
    # Only a box with a button needs to know what lies in it.
    buttons = "utton" in html or "UTTON" in html
    parts = CUT.split(html)
    parts.append("")
    walk = iter(parts)
    for text, tag in zip(walk, walk, strict=True):
        if text and (text := text.strip(SPACES)):
            if "  " in text or not text.isprintable():
                text = BLANKS.sub(" ", text)
            if comment:
                current = Block("comment", "comment", ())
                out.append(current)
                comment = "-->" not in text
            elif current is None:
                name, path, _ = stack[-1] if stack else ("", "", 0)
                current = Block(path, name, tuple([e[2] for e in stack]) if buttons else ())
                out.append(current)
            current.pieces.append(number)
            current.parts.append(text)
            number += 1
            n = _count(text)
            if n:
                current.words += n
                current.shown += 1
                if links:
                    current.linked += n
                if spans:
                    current.spanned += n
                if text[-1] in ENDS or text[-1] in QUOTES and SENTENCE.search(text):
                    current.ended += 1
            if current.tail == "comment":
                current = None
        if not tag:
            continue
        if comment:
            comment = not tag.endswith("-->")
            continue
        what, name, key = ("inline", "a", "a") if tag.startswith("<a ") else known(tag) or _tag(tag)
        if what == "comment":
            comment = not tag.endswith("-->")
            continue
        if raw:
            if what != "close" or name != raw:
                continue
            raw = ""
        if what == "close":
            current = None
            links = spans = 0
            if stack and stack[-1][0] == name:
                stack.pop()
            else:
                _close(stack, (name,), ("table", "body") if name not in ("table", "body", "html") else ())
        elif what == "inline":
            links += name == "a"
            spans += key == "s"
        elif what == "end":
            if name == "a":
                links = 0
            elif name == "span" and spans:
                spans -= 1
        elif what == "open":
            current = None
            links = spans = 0
            if stack:
                if name in CLOSES_P:
                    _close(stack, ("p",), SCOPES)
                if name in LIST_ITEMS:
                    _close(stack, ("td", "th") if name in ("td", "th") else (name,), ("table",) if name in ("td", "th") else ("ul", "ol", "dl"))
                elif name == "tr":
                    _close(stack, ("tr",), ("table",))
                elif name == "body":
                    stack.clear()
            if name in RAW:
                raw = name
            above = stack[-1][1] if stack else ""
            serial += 1
            stack.append((name, above if name in ("html", "body") else f"{above}>{key}" if above else key, serial))
        elif name == "br" and current is not None:
            current.breaks += 1
    for block in out:
        _shape(block)
    if buttons:
        _notices(out)
    return out


def _notices(page: list[Block]) -> None:
    """A small box with a button and no heading is a notice as a whole."""
    for button in page:
        if button.tail != "button" or len(button.chain) < 2 or button.path.count(">") < 1:
            continue
        box = button.chain[-2]
        inside = [b for b in page if box in b.chain]
        if sum(b.words for b in inside) <= NOTICE_WORDS and not any(b.tail in HEADINGS for b in inside):
            for block in inside:
                block.mark, block.running = button.mark, False


def _close(stack: list[tuple[str, str, int]], names: tuple[str, ...], within: tuple[str, ...] | frozenset[str]) -> None:
    """Closes the innermost of the named elements, if it is open within the nearest of the enclosing ones."""
    for at in range(len(stack) - 1, -1, -1):
        name = stack[at][0]
        if name in names:
            del stack[at:]
            return
        if name in within:
            return


def _shape(block: Block) -> None:
    """What shows at a block alone: whether it is running text, or a list, a path or a heading of a box."""
    block.text = text = block.parts[0] if len(block.parts) == 1 else " ".join(block.parts)
    total, tail = block.words, block.tail
    kind = ""
    if block.linked == total:
        kind = "~a"
    elif not block.ended:
        if block.spanned == total or block.shown > 1 and block.breaks >= block.shown - 1:
            kind = "~l"
        if CRUMBS.search(text):
            kind = "~c"
    block.key = block.path + kind
    block.hidden = tail in HIDDEN
    block.mark = ""
    if kind or tail in SIDE:
        at = (block.path, tail, kind)
        block.mark = _marks.get(at) or _landmark(*at)
    block.running = not block.hidden and not block.mark and total >= RUNNING_WORDS


def _element(step: str) -> str:
    return re.split(r"[.#@:]", step, maxsplit=1)[0]


def _landmark(path: str, tail: str, kind: str) -> str:
    """A box's name, the same for its headings, its lists and their items."""
    steps = path.split(">")
    if tail in SIDE:
        steps.pop()
    while steps and _element(steps[-1]) in ("ul", "ol", "li", "dl", "dt", "dd"):
        steps.pop()
    if len(_marks) > 50_000:
        _marks.clear()
    _marks[path, tail, kind] = mark = ">".join(steps) + (kind if kind == "~c" else "~")
    return mark


def stream(page: list[Block]) -> tuple[list[str], list[tuple[int, Block]]]:
    """The page's landmarks, with repetitions folded, and its shown blocks: text blocks with their slot (slot i lies before
    landmark i), landmarks with their number."""
    marks: list[str] = []
    placed: list[tuple[int, Block]] = []
    fresh = True
    for block in page:
        if block.hidden:
            continue
        if not block.mark:
            placed.append((len(marks), block))
            fresh = True
            continue
        if fresh or marks[-1] != block.mark:
            marks.append(block.mark)
            fresh = False
        placed.append((len(marks) - 1, block))
    return marks, placed


def _hash(text: str) -> int:
    return xxhash.xxh3_64_intdigest(text.encode("utf-8", "surrogatepass")) - (1 << 63)


def _contents(page: list[Block]) -> Callable[[Block], int]:
    """What tells a page's content from others', seen from one of its blocks: the least hash of the sentences in the other long
    texts, which edited copies mostly share; where there are none, the longest other running text."""
    running = [b for b in page if b.running]
    least: list[tuple[int, Block]] = []
    for block in running:
        if block.words > SHORT_WORDS:
            hashes = [_hash(x) for x in (x.strip().lower() for x in STOPS.split(block.text)) if len(x) > 12]
            if hashes:
                least.append((min(hashes), block))
    least.sort(key=lambda x: x[0])
    longest = sorted(running, key=lambda b: (len(b.text), b.text), reverse=True)

    def content(block: Block) -> int:
        for found, other in least[:2]:
            if other is not block:
                return found
        return _hash(next((b.text for b in longest[:2] if b is not block), ""))

    return content


BLOCK = "slot:int,key:string,cell:bigint,other:bigint,text:bigint,content:bigint,words:int,repeats:boolean,long:boolean,mark:boolean,first:int,n:int"
_BLOCK_TYPES = {"int": pa.int32(), "string": pa.string(), "bigint": pa.int64(), "boolean": pa.bool_()}


def _may_repeat(block: Block) -> bool:
    """Whether a block is an item or heading, which recur in bodies too."""
    return block.tail in NEVER_TEMPLATE


def _above(path: str) -> str:
    return path.rpartition(">")[0]


def _beside(at: int, block: Block, slots: dict[int, list[Block]]) -> tuple[Block, Block] | None:
    """Text blocks before and behind a landmark that it may belong with: of its own path, or under a subheading of their element."""
    if block.tail in SUBHEADINGS:
        above = _above(block.path)
        fits = lambda b: b.running and _above(b.path) == above
    elif block.tail not in SIDE:
        fits = lambda b: b.key == block.path
    else:
        return None
    before = next((b for b in reversed(slots.get(at, ())) if fits(b) or block.tail in SUBHEADINGS and b.tail in HEADINGS and _above(b.path) == _above(block.path)), None)
    behind = next((b for b in slots.get(at + 1, ()) if fits(b)), None)
    return (before, behind) if before and behind else None


def parsed(pages: DataFrame, with_text: bool) -> DataFrame:
    """One row per page (id, site, html): (page, id, site, home, stream, marks, n_blocks, blocks), as a table.

    cell is the number of a kind of block in a slot of a stream of a site; other is that of the text before a landmark, whose
    cell is that of the text behind it. Texts are kept only where they are wanted.
    """
    names = [f.split(":") for f in BLOCK.split(",")] + ([["body", "string"]] if with_text else [])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[tuple] = []
            found: list[tuple] = []
            ends = [0]
            for key, name, html in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                page = blocks(html)
                marks, placed = stream(page)
                home, number = _hash(name), _hash("\n".join(marks))
                content = _contents(page)
                slots: dict[int, list[Block]] = {}
                for slot, block in placed:
                    if not block.mark:
                        slots.setdefault(slot, []).append(block)
                        block.cell = _hash(f"{home} {number} {slot} {block.key}")
                for slot, block in placed:
                    if block.mark:
                        near = _beside(slot, block, slots)
                        if near is None:
                            continue
                        cell, other = near[1].cell, near[0].cell
                    else:
                        cell, other = block.cell, None
                    words = min(block.words, COUNTED_WORDS) if block.running else 0
                    row = (slot, block.key, cell, other, _hash(block.text), content(block), words, block.tail in NEVER_TEMPLATE, block.words > SHORT_WORDS, bool(block.mark), block.pieces[0], len(block.pieces))
                    found.append((*row, block.text) if with_text else row)
                ends.append(len(found))
                rows.append((key, name, home, number, marks, sum(map(len, slots.values()))))
            columns = list(zip(*found, strict=True)) if found else [()] * len(names)
            fields = [pa.array(c, _BLOCK_TYPES[kind]) for c, (_, kind) in zip(columns, names, strict=True)]
            structs = pa.StructArray.from_arrays(fields, names=[n for n, _ in names])
            columns = list(zip(*rows, strict=True)) if rows else [()] * 6
            types = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.list_(pa.string()), pa.int32()]
            arrays = [pa.array(c, t) for c, t in zip(columns, types, strict=True)]
            yield pa.RecordBatch.from_arrays([*arrays, pa.ListArray.from_arrays(pa.array(ends, pa.int32()), structs)], names=["id", "site", "home", "stream", "marks", "n_blocks", "blocks"])

    inner = ",".join(f"{n}:{k}" for n, k in names)
    schema = f"id bigint, site string, home bigint, stream bigint, marks array<string>, n_blocks int, blocks array<struct<{inner}>>"
    made = pages.select("id", "site", "html").mapInArrow(run, schema)
    return materialise(made.select(F.monotonically_increasing_id().alias("page"), "*"), "pages")


def align(wrapper: Sequence[str], marks: Sequence[str]) -> list[tuple[int, int]]:
    """Pairs of equal places of the wrapper and a stream: a longest common subsequence, the earliest of several.

    The table of lengths is kept as one number a row, whose bits say where the length grows (Crochemore et al., 2001).
    """
    n, m = len(wrapper), len(marks)
    where: dict[str, int] = defaultdict(int)
    for i, mark in enumerate(wrapper):
        where[mark] |= 1 << (n - 1 - i)
    every = (1 << n) - 1
    rows = [every] * (m + 1)
    for j in range(m - 1, -1, -1):
        row = rows[j + 1]
        hit = row & where.get(marks[j], 0)
        rows[j] = ((row + hit) | (row - hit)) & every
    length = lambda i, j: n - i - (rows[j] & ((1 << (n - i)) - 1)).bit_count()
    out, i, j = [], 0, 0
    while i < n and j < m:
        if wrapper[i] == marks[j]:
            out.append((i, j))
            i, j = i + 1, j + 1
        elif length(i + 1, j) >= length(i, j + 1):
            i += 1
        else:
            j += 1
    return out


def infer(streams: Iterable[Sequence[str]]) -> list[str]:
    """The wrapper of streams, or of wrappers: its landmarks in order. Each is aligned to it, and what it lacks is put in as optional."""
    wrapper: list[str] = []
    for marks in streams:
        pairs = [(-1, -1), *align(wrapper, marks), (len(wrapper), len(marks))]
        merged: list[str] = []
        for (i, j), (i2, j2) in pairwise(pairs):
            merged += wrapper[i + 1 : i2] + list(marks[j + 1 : j2])
            if i2 < len(wrapper):
                merged.append(wrapper[i2])
        wrapper = merged
    return wrapper


def candidates(wrapper: Sequence[str], marks: Sequence[str], kept: Sequence[bool]) -> list[tuple[int, int]]:
    """For each slot of a stream the first and last slot of the wrapper that it may be. Only kept landmarks are in the wrapper."""
    own = [j for j, k in enumerate(kept) if k]
    place = {own[j]: i for i, j in align(wrapper, [marks[j] for j in own])}
    before, at = [0], 0
    for j in range(len(marks)):
        at = place[j] + 1 if j in place else at
        before.append(at)
    behind, at = [len(wrapper)], len(wrapper)
    for j in range(len(marks) - 1, -1, -1):
        at = place.get(j, at)
        behind.append(at)
    return list(zip(before, reversed(behind), strict=True))


def _ordered(streams: Counter[tuple[str, ...]]) -> list[tuple[str, ...]]:
    """Usual streams first, of these the fullest: they have the optional landmarks in their order."""
    usual = USUAL_SHARE * sum(streams.values())
    return sorted(streams, key=lambda m: (streams[m] < usual, -len(m) if streams[m] >= usual else 0, -streams[m], m))


WRAPPER = "site string, a bigint, wrapper array<string>"


def _range_wrappers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One wrapper for each site of a partition that is sorted by site (site, kept marks, a)."""
    streams: Counter[tuple[str, ...]] = Counter()
    site: str | None = None

    def made() -> pa.RecordBatch:
        arrays = [pa.array([site], pa.string()), pa.array([streams.total()], pa.int64()), pa.array([infer(_ordered(streams))], pa.list_(pa.string()))]
        return pa.RecordBatch.from_arrays(arrays, names=["site", "a", "wrapper"])

    for batch in batches:
        for name, marks, a in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if name != site:
                if site is not None:
                    yield made()
                streams.clear()
                site = name
            streams[tuple(marks)] += a
    if site is not None:
        yield made()


def _merged(group: pd.DataFrame) -> pd.DataFrame:
    """The wrapper of a site from those of its ranges, of which there are at most as many as partitions."""
    streams: Counter[tuple[str, ...]] = Counter()
    for wrapper, a in zip(group["wrapper"], group["a"], strict=True):
        streams[tuple(wrapper)] += int(a)
    return pd.DataFrame({"site": group["site"].iloc[:1], "a": [streams.total()], "wrapper": [infer(_ordered(streams))]})


def _place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        loaded: dict[str, list[str]] = {}
        ranges = []
        for site, marks, kept, wrapper in zip(batch.column(0).to_pylist(), *(batch.column(i).to_pylist() for i in (2, 3, 5)), strict=True):
            ranges.append(candidates(loaded.setdefault(site, wrapper), marks, kept))
        slots = [pa.array([[r[i] for r in found] for found in ranges], pa.list_(pa.int32())) for i in (0, 1)]
        yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in (0, 1, 2, 4)), *slots], names=["site", "stream", "marks", "foreign", "los", "his"])


def site_verdicts(rows: pd.DataFrame) -> list[bool]:
    """For each row whether its kind of block belongs to the body in those slots of the wrapper.

    rows: lo, hi (slots of the wrapper), key, b (words of running text), fixed (template) of one site.
    """
    cells = sorted(zip(rows["lo"], rows["hi"], rows["key"], rows["b"].astype(float), rows["fixed"], strict=True), key=lambda r: (r[0] != r[1], *r[:3]))
    mass: dict[int, dict[str, float]] = defaultdict(lambda: defaultdict(float))
    for lo, hi, key, words, fixed in cells:
        if not fixed and (lo == hi or words):
            # A slot that several may be is the one of them that holds most of this kind of block.
            held = [s for s in mass if lo <= s <= hi] if hi > lo else [lo]
            mass[max(held, key=lambda s: (mass[s].get(key, 0.0), -s), default=lo)][key] += words
    weight = {s: sum(keys.values()) for s, keys in mass.items()}
    most = max(weight.values(), default=0.0)
    bodies = sorted(s for s, n in weight.items() if n >= BODY_SHARE * most)
    whole: Counter[str] = Counter()
    inner: Counter[str] = Counter()
    for s, keys in mass.items():
        whole.update(keys)
        if s in bodies:
            inner.update(keys)
    # Kinds of block whose element is their own belong to the body wherever they stand.
    own = {k for k, n in inner.items() if n > 0 and n >= 0.9 * whole[k] and re.search(r"[>.#@]", k)}
    some = lambda lo, hi: bisect_left(bodies, lo) < bisect_right(bodies, hi)
    return [not fixed and (key in own or some(lo, hi)) for lo, hi, key, fixed in zip(rows["lo"], rows["hi"], rows["key"], rows["fixed"], strict=True)]


def _judge(group: pd.DataFrame) -> pd.DataFrame:
    return group[["site", "lo", "hi", "key"]].assign(body=site_verdicts(group))


def placed_streams(streams: DataFrame) -> DataFrame:
    """(site, stream, marks, foreign, los, his) of streams (site, stream, marks, a blocks, n pages): the slots of its site's wrapper that each slot may be.

    A stream is foreign to a site if its landmarks are rare there but usual on another site, or if there is no site.
    """
    split = streams.select("site", "stream", "a", "n", F.explode(F.array_distinct("marks")).alias("mark"))
    totals = streams.groupBy("site").agg(F.sum("a").alias("total"))
    shares = split.groupBy("site", "mark").agg(F.sum("a").alias("a"), F.sum("n").alias("pages")).join(totals, "site").select("site", "mark", "pages", (F.col("a") / F.col("total")).alias("share"))
    shares = shares.join(shares.groupBy("mark").agg(F.max("share").alias("most")), "mark")
    rare = F.avg((F.col("share") < FOREIGN_SHARE * F.col("most")).cast("int"))
    usual = F.collect_list(F.when((F.col("share") >= WRAPPER_SHARE) & (F.col("pages") >= WRAPPER_PAGES), F.col("mark")))
    seen = split.join(shares, ["site", "mark"]).groupBy("site", "stream").agg(rare.alias("rare"), usual.alias("usual"))
    foreign = F.coalesce((F.col("rare") > FOREIGN_MARKS) | (F.col("site") == ""), F.lit(False))
    kept = F.transform("marks", lambda m: F.array_contains(F.coalesce("usual", F.array().cast("array<string>")), m))
    known = streams.join(seen, ["site", "stream"], "left").select("site", "stream", "marks", kept.alias("kept"), foreign.alias("foreign"), "a")
    known = materialise(known, "streams")
    ranged = known.select("site", F.transform(F.filter(F.arrays_zip("marks", "kept"), lambda x: x["kept"]), lambda x: x["marks"]).alias("marks"), "a", "stream")
    ranged = ranged.repartitionByRange("site", "stream").sortWithinPartitions("site", "stream").drop("stream")
    wrappers = ranged.mapInArrow(_range_wrappers, WRAPPER).groupBy("site").applyInPandas(_merged, WRAPPER)
    rows = known.join(wrappers.select("site", "wrapper"), "site").select("site", "stream", "marks", "kept", "foreign", "wrapper")
    return rows.mapInArrow(_place, "site string, stream bigint, marks array<string>, foreign boolean, los array<int>, his array<int>")


def body_cells(cells: DataFrame) -> DataFrame:
    """(cell) of the body, of cells (site, stream, slot, key, cell, a, marks, foreign, body).

    Pages of other sites stand under a site's name too, and records without a site are of all. Their streams get the votes of
    the streams that are not foreign: in the same slot of the same stream, else between the same landmarks, else of the same
    kind of block. Without a vote, and in all other streams, the site's own verdict stands.
    """
    edges = F.concat(F.array(F.lit("^")), F.col("marks"), F.array(F.lit("$")))
    slot = F.col("slot")
    home = cells.where("NOT foreign").withColumns({"before": F.element_at(edges, slot + 1), "after": F.element_at(edges, slot + 2)})
    out = cells.where("foreign").withColumns({"before": F.element_at(edges, slot + 1), "after": F.element_at(edges, slot + 2)})
    for vote, by in (("same", ["stream", "slot", "key"]), ("between", ["before", "after", "key"]), ("kind", ["key"])):
        votes = home.groupBy(by).agg((2 * F.sum(F.when(F.col("body"), F.col("a")).otherwise(0)) > F.sum("a")).alias(vote))
        out = out.join(votes, by, "left")
    return home.where("body").select("cell").union(out.where(F.coalesce("same", "between", "kind", "body")).select("cell"))


def templates(each: DataFrame) -> DataFrame:
    """(site, key, n, fixed) of blocks: the template texts as text XOR home, with the n different contents that they stand beside."""
    texts = each.where("NOT repeats").select("site", "home", "mark", "long", "key", "text", "content").distinct()
    # Different contents of each text of a site, and sites of each text.
    per_text = texts.groupBy("site", "home", "key", "text").agg(F.count("*").alias("n"))
    # Long texts see a page's content without themselves, so they count only where a site has no others.
    contents = texts.where("NOT mark").groupBy("site", "content").agg(F.min("long").alias("long")).groupBy("site").agg(F.coalesce(F.nullif(F.count_if(~F.col("long")), F.lit(0)), F.count("*")).alias("contents"))
    per_text = materialise(per_text.join(contents, "site"), "texts")
    sites = per_text.groupBy("text").agg(F.count_distinct("site").alias("sites"), F.sum("n").alias("everywhere")).where((F.col("sites") >= TEMPLATE_SITES) & (F.col("everywhere") >= TEMPLATE_PAGES * F.col("sites")))
    often = (F.col("n") >= TEMPLATE_PAGES) & (F.col("n") >= TEMPLATE_SHARE * F.col("contents"))
    known = per_text.join(sites.select("text", F.lit(True).alias("known")), "text", "left").where(often | F.col("known"))
    made = materialise(known.select("site", "key", "n", F.col("text").bitwiseXOR(F.col("home")).alias("fixed")), "templates")
    discard(per_text)
    return made


def placed_cells(seen: DataFrame, each: DataFrame) -> DataFrame:
    """(site, stream, slot, key, cell, a, b, marks, foreign, lo, hi): kinds of block in the slots of the streams, with their number,
    their words of running text, and the slots of the wrapper that they may be in."""
    counted = each.where("NOT mark").groupBy("site", "stream", "slot", "key", "cell").agg(F.count("*").alias("a"), F.sum("words").cast("bigint").alias("b"))
    streams = seen.groupBy("site", "stream", "marks").agg(F.sum("n_blocks").alias("a"), F.count("*").alias("n")).where("a > 0")
    at = lambda name: F.get(F.col(name), F.col("slot"))
    return materialise(counted.join(placed_streams(streams), ["site", "stream"]).withColumns({"lo": at("los"), "hi": at("his")}).drop("los", "his"), "cells")


Model = tuple[DataFrame, DataFrame]


def model(seen: DataFrame) -> Model:
    """((cell), (fixed)) of parsed pages, as tables: the cells of the bodies, and the template texts as text XOR home."""
    each = seen.select("site", "home", "stream", F.inline("blocks"))
    # Neither needs the other, so their stages may share the cluster.
    inheriting = inheritable_thread_target(seen.sparkSession)
    with ThreadPoolExecutor(2) as pool:
        texts = pool.submit(inheriting(templates), each)
        made = pool.submit(inheriting(placed_cells), seen, each)
        judged, cells = texts.result(), made.result()
    fixed_n = judged.groupBy("site", "key").agg(F.sum("n").alias("fixed_n"))
    sums = cells.groupBy("site", "key").agg(F.sum("a").alias("a"), F.sum("b").alias("b")).join(fixed_n, ["site", "key"])
    some = (F.col("fixed_n") >= TEMPLATE_BLOCKS * F.col("a")) & (F.col("b") < TEMPLATE_WORDS * F.col("a"))
    keys = sums.where(some | (F.col("fixed_n") >= TEMPLATE_NEARLY_ALL * F.col("a"))).select("site", "key", F.lit(True).alias("fixed"))
    # What a site's verdict is made of is bounded by its wrapper and kinds of block, however many pages and streams it has.
    masses = cells.groupBy("site", "lo", "hi", "key").agg(F.sum("b").alias("b")).join(keys, ["site", "key"], "left").na.fill({"fixed": False})
    verdicts = masses.groupBy("site").applyInPandas(_judge, "site string, lo int, hi int, key string, body boolean")
    verdicts = materialise(cells.join(verdicts, ["site", "lo", "hi", "key"]), "verdicts")
    found = materialise(body_cells(verdicts), "bodies")
    discard(cells, verdicts)
    return found, judged.select("fixed").distinct()


def bodies(seen: DataFrame, found: Model) -> DataFrame:
    """(page, id, first, n[, body]) of the blocks of all bodies. The model is broadcast where it is small, else joined by shuffle."""
    cells, fixed = (bounded(t, BROADCAST_KEYS) for t in found)
    each = seen.select("page", "id", "home", F.inline("blocks"))
    each = each.join(cells, "cell", "left_semi")
    # A landmark must stand between two blocks of the body.
    both = each.where("mark").join(cells.withColumnRenamed("cell", "other"), "other", "left_semi")
    recurs = (F.col("text").bitwiseXOR(F.col("home")) == F.col("fixed")) & ~F.col("repeats")
    keep = ["page", "id", "first", "n", *(["body"] if "body" in each.columns else [])]
    return each.where("NOT mark").select(each.columns).union(both.select(each.columns)).join(fixed, recurs, "left_anti").select(keep)


def crawl_pages(records: DataFrame) -> DataFrame:
    """(id, site, html) of crawl records with text; the rest has no pieces."""
    return parallel(records.select(F.col("rec_id").alias("id"), site(F.col("url")).alias("site"), "html").where("html <> ''"))


def main_pieces(records: DataFrame) -> DataFrame:
    """(rec_id, piece_no INT): the pieces of each page's main body.

    * Pieces are the texts between tags, trimmed, the empty ones dropped, numbered from 0.
    * Null and empty html gives no rows; records without a usable URL share one wrapper and are judged as foreign to it. Records that repeat a page each get
      their rows. Other columns are not read; an empty table gives an empty result.
    """
    seen = parsed(crawl_pages(records), with_text=False)
    found = bodies(seen, model(seen))
    return found.select(F.col("id").alias("rec_id"), F.explode(F.sequence(F.col("first"), F.col("first") + F.col("n") - 1)).alias("piece_no"))
