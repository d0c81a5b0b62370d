"""Documents whose text was cut off.

Three kinds of evidence:

* whole texts, a self-join by prefix: in sorted order a text that is a strict prefix of any other is one of its successor;
* field limits: a length, in characters or bytes, at which a source has far more documents than at the lengths around it; a limit
  in bytes may fall inside a character and leaves one to three bytes less then;
* ends: a classifier of how texts end, which has learned from all texts of the corpus. It sees the last words, how the sentence
  and the line began, and whether the last word is unknown but the beginning of a known one (a prefix self-join of words).

One pass over the documents notes what the latter two need: lengths, marks of a cut, the last line of texts that may go on, and
how many documents have each word and each closing. A second one, which knows the words, makes the examples that the classifier
learns from and counts how lines begin. The whole texts are read again only for the self-join.
"""

from __future__ import annotations

import random
import re
import unicodedata
import zlib
from array import array
from bisect import bisect_left, bisect_right
from collections import Counter
from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
import xxhash
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from kvflow.session import bounded, discard, materialise, parallel

# What fields and feeds put behind a cut text; ends of sentences; tokens; markup.
CUT_MARKS = r"(?:\[\.\.\.\]|\[…\]|\((?:read )?more\)|\.\.\.|…|&hellip;)"
SURE_MARKS = r"(?:\[\.\.\.\]|\[…\]|\((?:read )?more\))$"
SENTENCE_END = r"[.!?。！？]"
TOKEN = r"https?://\S+|www\.\S+|\p{Han}|[\p{L}\p{M}]+(?:['’][\p{L}]+)*|\p{N}+|\n+|[^\s\p{L}\p{N}]"
TOKEN_ASCII = r"https?://\S+|www\.\S+|[A-Za-z]+(?:'[A-Za-z]+)*|[0-9]+|\n+|[^\sA-Za-z0-9]"
MARK_ENDS = ("...", "…", "...]", "…]", "more)", "&hellip;")
MARKUP = r"</?[a-zA-Z][^<>\n]*>|\[/?[a-zA-Z*][^\[\]\n]*\]|&(?:[a-z]+|#\d+);"
#: A word is known if it occurs in at least this share of the documents, and in at least so many. The classifier's vocabulary,
#: which is shipped to all workers, has at most KNOWN_WORDS of them, those in most documents.
KNOWN_SHARE = 0.0005
KNOWN_LEAST = 4
KNOWN_WORDS = 200_000
#: The classifier learns from all ends within each text, and from as many places to cut it, but at least so many.
CUTS_A_DOC = 6
#: Two last words close a text if at least so many texts, and this share of all, end with them; so for beginnings of last lines.
CLOSING_TEXTS = 3
CLOSING_SHARE = 0.0005
#: A word behind a sentence that this share of all texts end with, and that begins a sentence in fewer, is a closing in itself.
CLOSER_SHARE = 0.0001
CLOSING_TOKENS = 12
FEATURES = 1 << 18
#: An example has so many features; what it lacks is filled with a last feature that stays zero.
WIDTH = 24
#: The weights are those of least loss, summed over all examples, plus half this penalty times their squares; they are found
#: when the slope has fallen to this share of that at the start, or after so many passes over the examples.
PENALTY = 1.0
SLOPE_LEFT = 0.01
PASSES = 100
#: Steps remembered for the curvature.
MEMORY = 8
#: Slopes and losses are summed as whole multiples of 1 / FIXED, so that the order of the documents does not matter.
FIXED = 1 << 26
#: Sums are added up by blocks of so many.
SUMS_A_BLOCK = 1 << 14
#: Ends that are more likely cut than this are.
CUT_ABOVE = 0.45
#: A shorter text may be the beginning of another by chance.
PREFIX_CHARS = 24
#: A limit has so many documents at least, and so many times those at a length nearby.
LIMIT_DOCS = 5
LIMIT_TIMES = 8.0
LIMIT_AROUND = 25
#: A limit of bytes inside a character leaves up to so many bytes less.
LIMIT_MISSING = 3
BOUNDARY, UNKNOWN_NAME, UNKNOWN_WORD, NUMBER, LINK = "\n", "\x01N", "\x01w", "\x01#", "\x01u"
NUMBERS = {x: zlib.crc32(x.encode()) for x in (BOUNDARY, UNKNOWN_NAME, UNKNOWN_WORD, NUMBER, LINK)}
UNKNOWN = (NUMBERS[UNKNOWN_NAME], NUMBERS[UNKNOWN_WORD])
#: What the classifier sees of an end, by column: the last five classes, the last one last (0 to 4), three that begin the
#: sentence (5 to 7), four that begin the line (8 to 11), the line's first word (12), tokens of the sentence (13) and of the
#: line (14), what is known of the last word (15), whether the line opens the text (16), the last three and two letters (17, 18).
SEEN, LINE_SIZE, STATE = 19, 14, 15
#: The columns that each feature joins; -1 is the size of the line up to nine.
TEMPLATES = (
    (4,), (3,), (2,), (1,), (0,), (3, 4), (2, 3), (1, 2), (2, 4), (2, 3, 4), (1, 2, 3), (0, 1, 2), (15,), (15, 3), (15, 2, 3), (5, 6, 13), (5, 6, 7, 3),
    (13,), (12,), (8, 9, 10, 11, 14), (12, -1), (16,), (17,), (18, 3),
)
MIXER = np.uint64(0x9E3779B97F4A7C15)
#: Examples are made at once for texts of about so many characters.
CHARS_AT_ONCE = 500_000

ENDS = frozenset(".!?。！？")
STARTS_BEHIND = ENDS | {BOUNDARY}
LINKS = ("http://", "https://", "www.")

_token = regex.compile(TOKEN)
_token_ascii = re.compile(TOKEN_ASCII)
_markup = regex.compile(MARKUP)
_sentence_end = regex.compile(SENTENCE_END)
_invisible = regex.compile(r"[\s\p{Cf}]+$")
_cut_marks = re.compile(rf"(?a:(?:\s*{CUT_MARKS})+\s*\Z)")
_sure_mark = regex.compile(SURE_MARKS)
_open_markup = regex.compile(r"(?:<[a-zA-Z/][^<>\s]*|\[/?[a-zA-Z]+|&[a-z]{1,5}|&#\d*)$")
_smiley = re.compile(r":\w+:$")
_signature = regex.compile(r"\n(?:--|__+) ?\n?[^\n]*(?:\n[^\n]*)?$")
CLOSING = "\"'”’»)]*_"


def plain_of(text: str) -> str:
    """The text without markup, with one kind of line end."""
    plain = text.replace("\r\n", "\n").replace("\r", "\n") if "\r" in text else text
    return _markup.sub("", plain) if "<" in plain or "[" in plain or "&" in plain else plain


def tokens(text: str) -> list[str]:
    """Words, Han characters, numbers, links, line ends and signs of a text without markup."""
    plain = plain_of(text)
    found = (_token_ascii if plain.isascii() else _token).findall(plain)
    return [BOUNDARY if t[0] == "\n" else t for t in found] if "\n" in plain else found


def visible(text: str) -> str:
    """The text without white space and invisible characters at its end."""
    text = text.rstrip()
    return _invisible.sub("", text) if text and unicodedata.category(text[-1]) == "Cf" else text


def classes(found: list[str], known: frozenset[str]) -> list[str]:
    """Known words in lower case; others by their class."""
    out = []
    for t in found:
        low = t.lower()
        if low in known or not (t[0].isalnum() or t[0] == "w"):
            out.append(low)
        elif t[0].isdigit():
            out.append(NUMBER)
        elif "://" in t or t.startswith("www."):
            out.append(LINK)
        else:
            out.append(UNKNOWN_NAME if t[0].isupper() else UNKNOWN_WORD)
    return out


class Ends:
    """Whether a text goes on after its end: logistic regression over hashed features of the last tokens."""

    def __init__(self, known: list[str], weights: np.ndarray | None = None):
        self.known, self.sorted = frozenset(known), sorted(known)
        self.numbers = {word: _number(word) for word in known}
        self.weights = np.zeros(FEATURES + 1, np.float32) if weights is None else weights

    def begins_known(self, word: str) -> bool:
        """Whether the word is a strict prefix of a known one: in sorted order, of its successor."""
        at = bisect_right(self.sorted, word)
        return word not in self.known and at < len(self.sorted) and self.sorted[at].startswith(word)

    def numbered(self, found: list[str]) -> list[int]:
        """The numbers of the tokens' classes."""
        out = []
        for t in found:
            low = t.lower()
            number = self.numbers.get(low)
            if number is None:
                if not t[0].isalnum():
                    number = _number(low)
                elif t[0].isdigit():
                    number = NUMBERS[NUMBER]
                elif "://" in t or t.startswith("www."):
                    number = NUMBERS[LINK]
                else:
                    number = NUMBERS[UNKNOWN_NAME if t[0].isupper() else UNKNOWN_WORD]
            out.append(number)
        return out

    def seen(self, numbers: list[int], size: int, start: int, tail: list[int], first: str, last: str, opens: bool) -> list[int]:
        """What the classifier sees of a last line: its first `size` tokens, with the sentence from `start` on, and then those of the tail.

        opens: no line is before it.
        """
        near = (numbers[max(size - 5, 0) : size] + tail)[-5:]
        head = (numbers[start : min(start + 3, size)] + tail)[:3]
        begin = (numbers[: min(4, size)] + tail)[:4]
        if len(near) < 5:
            near = [NUMBERS[BOUNDARY]] * (5 - len(near)) + near
            begin += [0] * (4 - len(begin))
        head += [0] * (3 - len(head))
        low = last.lower()
        unknown = near[-1] in UNKNOWN
        state = 32 * unknown + 16 * self.begins_known(low) + min(len(last), 9)
        ending = (_number(low[-3:]), _number(low[-2:])) if unknown else (0, 0)
        return [*near, *head, *begin, _number(first.lower()), min(size + len(tail) - start, 30), min(size + len(tail), 12), state, opens, *ending]

    def likelihoods(self, lines: list[list[str]], opens: list[bool]) -> np.ndarray:
        """Of texts being cut after the tokens of these last lines."""
        rows = [self.seen(self.numbered(line), len(line), _begun(line)[-1], [], line[0], line[-1], first) for line, first in zip(lines, opens, strict=True)]
        return 1 / (1 + np.exp(-self.weights[features(np.array(rows, np.int64).reshape(-1, SEEN))].sum(axis=1)))

    def _head(self, line: list[str]) -> str:
        return " ".join(classes(line[:4], self.known))

    def closes(self, line: list[str], openings: frozenset[str]) -> bool:
        """Whether a last line, as tokens, is a short one that begins as only last lines do, like a signature."""
        return 4 <= len(line) <= CLOSING_TOKENS and BOUNDARY + self._head(line) in openings

    def examples(self, text: str, closings: frozenset[str]) -> tuple[list[int], list[int], list[str], list[int], str, bool]:
        """(ends, cuts, beginnings of lines, own end, beginning of the last line, whether it is a short one) of a text, ends and cuts as seen, one after the other.

        All ends of its sentences and lines are learned from as whole, random places, as many, as cut. A text's own end may
        be a cut itself, so it counts only where several texts end alike: with one of the closings, or in a last line whose
        beginning turns out to be an opening. The beginnings are those of long lines and of those that end a sentence.
        """
        lines = plain_of(text).split("\n")
        known, lengths = [], []
        ends: list[int] = []
        own: list[int] = []
        heads, n_ends = [], 0
        for at, line in enumerate(lines):
            lengths.append(len(line) + 1)
            spans = [(m.group(), m.start()) for m in (_token_ascii if line.isascii() else _token).finditer(line)]
            found = [t for t, _ in spans]
            numbers, begun = self.numbered(found), _begun(found)
            known.append((found, [x for _, x in spans], numbers, begun))
            closed = bool(found) and found[-1][0] in ENDS
            if len(found) > CLOSING_TOKENS or closed:
                heads.append(self._head(found))
            for i in range(1, len(found) + 1):
                if found[i - 1][0] in ENDS or i < len(found) and found[i][0] not in ENDS:
                    continue
                row = self.seen(numbers, i, begun[i], [], found[0], found[i - 1], not at)
                if i == len(found) and at == len(lines) - 1 and closing_of([*([BOUNDARY] if at else []), *found[-2:]][-2:]) not in closings:
                    own = row
                else:
                    ends += row
                    n_ends += 1
        found = known[-1][0]
        last_head, short = self._head(found), 4 <= len(found) <= CLOSING_TOKENS and found[-1][0] not in ENDS
        begins = [0, *accumulate(lengths)]
        rng = random.Random(zlib.crc32(text.encode("utf-8", "replace")))
        cuts: list[int] = []
        for _ in range(max(CUTS_A_DOC, n_ends)):
            place = int(rng.random() * begins[-1]) + 1
            at = bisect_left(begins, place) - 1
            found, starts, numbers, begun = known[at]
            place -= begins[at]
            size = bisect_left(starts, place) - 1
            if size < 0:
                continue
            token = found[size]
            left = place - starts[size]
            if left < len(token):
                part = token[:left]
                tail = [part] if part.isalnum() else tokens(part)
                if not tail or tail[-1][0] in ENDS or tail[-1].startswith(LINKS):
                    continue  # a link cut short is a link
                cuts += self.seen(numbers, size, begun[size], self.numbered(tail), found[0] if size else tail[0], tail[-1], not at)
            elif size + 1 < len(found) and not token.startswith(LINKS):
                # Between words, or before a sign; what ends a sentence or line is no cut.
                behind = lines[at][starts[size] + len(token)]
                if behind == " " or not behind.isspace() and behind not in ENDS and token[0] not in ENDS:
                    cuts += self.seen(numbers, size + 1, begun[size + 1], [], found[0], token, not at)
        return ends, cuts, heads, own, last_head, short


def _number(text: str) -> int:
    return zlib.crc32(text.encode("utf-8", "replace"))


def _begun(line: list[str]) -> list[int]:
    """For each number of tokens of a line, from none to all, where the sentence begins that they end in."""
    out, start = [0], 0
    for i, token in enumerate(line, 1):
        if token[0] in ENDS:
            start = i
        out.append(start)
    return out


def features(seen: np.ndarray) -> np.ndarray:
    """Feature numbers by row of what the classifier sees."""
    value = seen.astype(np.uint64).T
    out = np.empty((len(seen), WIDTH), np.int32)
    for i, columns in enumerate(TEMPLATES):
        mixed = np.full(len(seen), i + 1, np.uint64)
        for column in columns:
            mixed = (mixed ^ (np.minimum(value[LINE_SIZE], 9) if column < 0 else value[column])) * MIXER
            mixed ^= mixed >> np.uint64(29)
        out[:, i] = mixed & np.uint64(FEATURES - 1)
    # Only unknown words have an ending.
    out[seen[:, STATE] < 32, WIDTH - 2 :] = FEATURES
    return out


def _portions(texts: list[str]) -> Iterator[list[str]]:
    """Texts one after the other, so many together that they reach CHARS_AT_ONCE."""
    part, chars = [], 0
    for text in texts:
        part.append(text)
        chars += len(text)
        if chars >= CHARS_AT_ONCE:
            yield part
            part, chars = [], 0
    if part:
        yield part


def _made(shipped: Broadcast, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The examples of each text, packed (kind 0), those that count only if a term is an opening (kind 1), and of each batch how many texts end in a short line that begins so (kind 2) and how many other lines do (kind 3)."""
    ends, closings = shipped.value

    def packed(seen: array, label: np.ndarray | int) -> np.ndarray:
        found = features(np.frombuffer(seen, np.int64).reshape(-1, SEEN))
        return np.column_stack([np.broadcast_to(label, len(found)), found]).astype(np.int32)

    for batch in batches:
        for texts in _portions(batch.column(0).to_pylist()):
            short: Counter[str] = Counter()
            long: Counter[str] = Counter()
            seen, doubtful, sizes, terms = array("q"), array("q"), [], []
            for text in texts:
                whole, cut, heads, own, head, short_line = ends.examples(text, closings)
                long.update(heads)
                seen.extend(whole)
                seen.extend(cut)
                sizes.append((len(whole) // SEEN, len(cut) // SEEN))
                if own:
                    doubtful.extend(own)
                    terms.append(BOUNDARY + head)
                if short_line:
                    short[head] += 1
            matrix = packed(seen, np.repeat(np.tile([0, 1], len(sizes)), np.array(sizes, np.int64).ravel()))
            last = np.cumsum([a + b for a, b in sizes])[:-1]
            rows = [(0, None, None, x.tobytes()) for x in np.split(matrix, last)]
            rows += [(1, term, None, x.tobytes()) for term, x in zip(terms, packed(doubtful, 0), strict=True)]
            for kind, counts in ((2, short), (3, long)):
                rows += [(kind, BOUNDARY + head, n, None) for head, n in counts.items()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int8(), pa.string(), pa.int64(), pa.binary()), strict=True)], names=["kind", "term", "n", "packed"])


def _summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(block, packed): the sums of all rows of a block."""
    sums: dict[int, np.ndarray] = {}
    for batch in batches:
        for block, packed in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            part = np.frombuffer(packed, np.int64)
            sums[block] = sums[block] + part if block in sums else part
    yield _blocks(sums)


def _blocks(sums: dict[int, np.ndarray]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array([x.tobytes() for x in sums.values()], pa.binary())], names=["block", "packed"])


def _over_all(examples: DataFrame, weights: np.ndarray | None, importance: tuple[float, float]) -> np.ndarray:
    """One pass over packed examples: the slope of each weight and, last, the loss; without weights how often each feature occurs and, last, how many are cut.

    Each task adds up its own, tasks add up each other's by blocks of weights, so the driver gets each number once.
    """
    spark = examples.sparkSession
    shipped = spark.sparkContext.broadcast((weights, importance))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights, importance = shipped.value
        total = np.zeros(FEATURES + 2, np.int64)
        for batch in batches:
            matrix = np.frombuffer(b"".join(batch.column(0).to_pylist()), np.int32).reshape(-1, WIDTH + 1)
            for part in np.array_split(matrix, len(matrix) // 65_536 + 1):
                label, at = part[:, 0], part[:, 1:]
                if weights is None:
                    slope, loss = np.ones(len(at)), label
                else:
                    score = weights[at].sum(axis=1)
                    weight = np.where(label == 1, *importance)
                    slope = np.rint((1 / (1 + np.exp(-score)) - label) * weight * FIXED)
                    loss = np.rint(np.logaddexp(0, np.where(label == 1, -score, score)) * weight * FIXED)
                total[: FEATURES + 1] += np.bincount(at.ravel(), np.repeat(slope, WIDTH), FEATURES + 1).astype(np.int64)
                total[-1] += int(loss.sum())
        yield _blocks({at: total[at : at + SUMS_A_BLOCK] for at in range(0, len(total), SUMS_A_BLOCK)})

    sums = examples.coalesce(spark.sparkContext.defaultParallelism).mapInArrow(run, "block int, packed binary").repartition("block").mapInArrow(_summed, "block int, packed binary")
    found = np.concatenate([np.frombuffer(r.packed, np.int64) for r in sorted(sums.collect(), key=lambda r: r.block)])
    shipped.destroy()
    return found if weights is None else found / FIXED


def learned(examples: DataFrame) -> np.ndarray:
    """The classifier's weights: logistic regression on all examples, by L-BFGS over weights scaled to like curvature.

    Both labels count alike as a whole.
    """
    seen = _over_all(examples, None, (1.0, 1.0))
    n, cut = int(seen[:-1].sum()) // WIDTH, int(seen[-1])
    if not n:
        return np.zeros(FEATURES + 1, np.float32)
    share = min(max(cut / n, 0.01), 0.99)
    importance = (0.5 / share, 0.5 / (1 - share))
    scale = 1 / np.sqrt(PENALTY + seen[:FEATURES] / 4)

    def at(scaled: np.ndarray) -> tuple[float, np.ndarray]:
        weights = scaled * scale
        sums = _over_all(examples, np.append(weights, 0), importance)
        return sums[-1] + PENALTY / 2 * float(weights @ weights), (sums[:FEATURES] + PENALTY * weights) * scale

    here = np.zeros(FEATURES)
    loss, slope = at(here)
    enough = SLOPE_LEFT * np.linalg.norm(slope)
    steps: list[tuple[np.ndarray, np.ndarray]] = []
    passes = 1
    while np.linalg.norm(slope) > enough and passes < PASSES:
        way, shares = slope.copy(), []
        for moved, turned in reversed(steps):
            shares.append((moved @ way) / (moved @ turned))
            way -= shares[-1] * turned
        # An example's features move together: without known curvature a step of this size never goes too far.
        way *= (steps[-1][0] @ steps[-1][1]) / (steps[-1][1] @ steps[-1][1]) if steps else 1 / WIDTH
        for (moved, turned), part in zip(steps, reversed(shares), strict=True):
            way += (part - (turned @ way) / (moved @ turned)) * moved
        size = 1.0
        while passes < PASSES:
            there = here - size * way
            new_loss, new_slope = at(there)
            passes += 1
            if new_loss <= loss - 1e-4 * size * (slope @ way):
                moved, turned = there - here, new_slope - slope
                if moved @ turned > 0:
                    steps = [*steps[1 - MEMORY :], (moved, turned)]
                here, loss, slope = there, new_loss, new_slope
                break
            size /= 2
    return np.append(here * scale, 0).astype(np.float32)


def closing_of(raw: list[str]) -> str:
    """The last two words or signs of a text; all ends of sentences count as one."""
    sign = raw[-2] if len(raw) > 1 else ""
    return f"{'.' if _sentence_end.match(sign) else sign} {raw[-1]}".lower()


def judged_end(text: str) -> tuple[str | None, list[str] | None]:
    """(evidence, tokens): what marks a cut at the text's end, or else its tokens if only the classifier can tell."""
    text = text.rstrip()
    if _sure_mark.search(text, max(len(text) - 20, 0)):
        return "mark", None
    raw = tokens(visible(text))
    opened = [at for at in map(text.rfind, "<[&") if at >= 0]
    if opened and _open_markup.search(text, min(opened)):
        return "markup", raw
    while raw and raw[-1] == BOUNDARY:
        raw.pop()
    return None, raw


def is_whole(text: str, raw: list[str]) -> bool:
    """Whether a text without mark ends as texts do: with a sentence, a sign, a signature or a link."""
    bare = visible(text)
    if "\r" in bare:
        bare = bare.replace("\r\n", "\n").replace("\r", "\n")
    if "<" in bare or "[" in bare or "&" in bare:
        bare = _markup.sub("", bare)
    before = ""
    while bare != before:
        before, bare = bare, bare.rstrip().rstrip(CLOSING)
    if not raw or not bare or raw[-1].startswith(LINKS):
        return True
    if bare[-1] in "….!?。！？" or unicodedata.category(bare[-1]) in ("So", "Sk") or bare[-1] == ":" and _smiley.search(bare, max(bare.rfind(":", 0, -1), 0)):
        return True
    # A signature begins at one of the last three line ends.
    at = len(bare)
    for _ in range(3):
        at = bare.rfind("\n", 0, max(at, 0))
    return bool(_signature.search(bare, max(at, 0)))


NOTES = (
    "kind tinyint, doc_id bigint, source string, copy bigint, bare bigint, chars int, bytes int, widest int, may_be boolean, "
    "evidence string, last array<string>, opens boolean, term string, n bigint"
)
_NOTE_TYPES = [pa.int8(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.bool_(), pa.string(), pa.list_(pa.string()), pa.bool_(), pa.string(), pa.int64()]


def _hash(text: str) -> int:
    return xxhash.xxh3_64_intdigest(text.encode("utf-8", "surrogatepass")) - (1 << 63)


def bare_of(text: str) -> str:
    """The text without the marks of a cut, and the white space around them, at its end."""
    return _cut_marks.sub("", text) if text.rstrip().endswith(MARK_ENDS) else text


def _noted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of each batch: one row of kind 0 per document, and how many documents have each word (kind 1), closing (kind 2), and beginning of a sentence or line (kind 3)."""
    for batch in batches:
        rows: list[tuple] = []
        words: Counter[str] = Counter()
        closings: Counter[str] = Counter()
        starts: Counter[str] = Counter()
        for doc, source, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            bare, kept = bare_of(text), text.rstrip(" ")
            widest = 1 if bare.isascii() else sum(max(bare) > c for c in "\x00\x7f\u07ff\uffff")
            # At a limit a text is cut unless it ends a sentence; with a mark behind the limit it is cut in any case.
            may_be = len(bare) < len(kept) or not _sentence_end.match(kept.rstrip("\r\n")[-1:])
            evidence, raw = judged_end(text)
            all_words = tokens(text) if raw is None else raw
            own = {t.lower() for t in all_words if t[0].isalpha()}
            if "://" in text or "www." in text:
                own = {t for t in own if "://" not in t and not t.startswith("www.")}
            words.update(own)
            last, opens = None, None
            if raw and not _sentence_end.match(raw[-1]):
                closings[closing_of(raw)] += 1
            starts.update({closing_of(all_words[i - 1 : i + 1]) for i in range(1, len(all_words) - 1) if all_words[i - 1] in STARTS_BEHIND})
            if raw and evidence is None and not is_whole(text, raw):
                line = len(raw)
                while line and raw[line - 1] != BOUNDARY:
                    line -= 1
                last, opens = raw[line:], line == 0
            rows.append((0, doc, source, _hash(text), _hash(bare.rstrip(" ")), len(bare), len(bare.encode()), widest, may_be, evidence, last, opens, None, None))
        for kind, counts in ((1, words), (2, closings), (3, starts)):
            rows += [(kind, *[None] * 11, term, n) for term, n in counts.items()]
        columns = list(zip(*rows, strict=True)) if rows else [()] * len(_NOTE_TYPES)
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, _NOTE_TYPES, strict=True)], names=[f.split()[0] for f in NOTES.split(", ")])


def prefixes_of_others(rows: DataFrame) -> DataFrame:
    """(text hash, chars, ends) as (bare, chars, sentence) of the different texts of rows (text) that are strict prefixes of another.

    Different texts are sorted by range partitions, whose bounds are sampled from the texts themselves, so texts with a
    common beginning are spread too; the last text of a partition is compared with the first of the next one.
    """
    texts = rows.select("text").distinct()
    ranged = texts.repartitionByRange("text").sortWithinPartitions("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        last = None
        for batch in batches:
            values = batch.column(0).to_pylist()
            before = [last, *values[:-1]]
            hit = [b for b, v in zip(before, values, strict=True) if b is not None and v.startswith(b)]
            # Only the texts at a partition's ends leave it.
            rows = [(_hash(h), len(h), bool(_sentence_end.match(h[-1:])), part, "prefix", None) for h in hit]
            if last is None and values:
                rows.append((None, None, None, part, "first", values[0]))
            last = values[-1] if values else last
            yield _edge(rows)
        if last is not None:
            yield _edge([(_hash(last), len(last), bool(_sentence_end.match(last[-1:])), part, "last", last)])

    def _edge(rows: list[tuple]) -> pa.RecordBatch:
        columns = zip(*rows, strict=True) if rows else [()] * 6
        types = [pa.int64(), pa.int32(), pa.bool_(), pa.int32(), pa.string(), pa.string()]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=["bare", "chars", "sentence", "part", "what", "text"])

    seen = materialise(ranged.mapInArrow(run, "bare bigint, chars int, sentence boolean, part int, what string, text string"), "prefixes")
    # Two rows a partition. Empty partitions lie between some of them, hence the next in order instead of the next number.
    edges = seen.where("what <> 'prefix'").withColumn("then", F.lead("text").over(Window.orderBy("part", F.col("what") == "last")))
    crossing = edges.where("what = 'last' AND startswith(then, text) AND then <> text")
    return seen.where("what = 'prefix'").union(crossing.drop("then")).select("bare", "chars", "sentence")


def _peaks(length: np.ndarray, n: np.ndarray, free: np.ndarray, least: int = LIMIT_AROUND + 1) -> np.ndarray:
    """Lengths with far more texts than those around. Found ones do not count as around others, which are sought again among the texts `free`."""
    lengths, at = np.unique(length, return_inverse=True)
    total, rest = np.bincount(at, n), np.bincount(at, free)
    low, high = np.searchsorted(lengths, lengths - LIMIT_AROUND), np.searchsorted(lengths, lengths + LIMIT_AROUND, "right")
    found = np.zeros(len(lengths), bool)
    while True:
        counted = np.where(found, 0, rest) if found.any() else total
        sums = np.concatenate([[0], np.cumsum(counted)])
        around = (sums[high] - sums[low] - counted) / (2 * LIMIT_AROUND)
        new = ~found & (lengths >= least) & (counted >= LIMIT_DOCS) & (counted >= LIMIT_TIMES * np.maximum(around, 0.5))
        if not new.any():
            return lengths[found]
        found |= new


def _limits(group: pd.DataFrame, least: int = LIMIT_AROUND + 1) -> pd.DataFrame:
    """The limits of one source from its texts' numbers by chars, bytes and bytes of the widest character."""
    chars, size, widest, n = (group[c].to_numpy(np.int64) for c in ("chars", "bytes", "widest", "n"))
    by_chars = _peaks(chars, n, n, least)
    rows = [("chars", x, 0) for x in by_chars]
    missing: dict[int, int] = {}
    for x in sorted(_peaks(size, n, np.where(np.isin(chars, by_chars), 0, n), least).tolist(), reverse=True):
        # A cut inside a character leaves up to three bytes less; a limit in characters, which ASCII texts have in bytes too, does not.
        above = [y for y in missing if y <= x + missing[y]]
        if not above:
            missing[x] = LIMIT_MISSING if n[size == x].sum() >= n[chars == x].sum() else 0
        elif n[(size == x) & (widest <= min(above) - x)].sum() >= LIMIT_DOCS:
            missing[x] = 0
    rows += [("bytes", x, less) for x, less in missing.items()]
    return pd.DataFrame(rows, columns=["unit", "length", "missing"]).assign(source=group["source"].iloc[0])[["source", "unit", "length", "missing"]]


def field_limits(rows: DataFrame, least: int = LIMIT_AROUND + 1) -> DataFrame:
    """(source, unit, length, missing): lengths at which a source's texts were cut, from the counts of all lengths.

    missing: so many bytes less may be left, where the character that the limit cuts in two needs more of them.
    """
    counts = rows.groupBy("source", "chars", "bytes", "widest").agg(F.count("*").alias("n"))
    return counts.groupBy("source").applyInPandas(lambda group: _limits(group, least), "source string, unit string, length int, missing int")


def truncated(documents: DataFrame, prefix_chars: int = PREFIX_CHARS, least_limit: int = LIMIT_AROUND + 1) -> DataFrame:
    """(doc_id, evidence), one row per cut document: 'prefix', 'limit', 'mark', 'markup' or 'goes on'.

    * Null and empty texts, and those that end with a sentence's end, a link, a signature or dots, are not cut unless they
      have the length of a limit and a mark of the cut. Of the prefixes of longer copies, those of prefix_chars characters and
      more that end within a sentence are cut; limits are sought from least_limit characters on. Both defaults leave out what
      is usual by chance in short posts; 1 finds all. Repeated texts are judged alike; a null source is a source of its own.
    * Texts are read whole; other columns than doc_id, source and text are not read. An empty table gives an empty result.
    """
    rows = documents.select("doc_id", F.coalesce("source", F.lit("")).alias("source"), "text").where("text <> ''")
    noted = materialise(parallel(rows).mapInArrow(_noted, NOTES), "notes")
    docs = noted.where("kind = 0")
    n_docs = docs.count()
    terms = materialise(noted.where("kind > 0").groupBy("kind", "term").agg(F.sum("n").alias("n")), "terms")
    often = (F.col("kind") == 1) & (F.col("n") >= max(KNOWN_LEAST, KNOWN_SHARE * n_docs)) | (F.col("kind") == 2) & (F.col("n") >= max(CLOSING_TEXTS, CLOSING_SHARE * n_docs))
    usual = terms.where(often).orderBy(F.desc("n"), "kind", "term").limit(KNOWN_WORDS).collect()
    # The classifier knows the words that close texts too, however rare they are elsewhere.
    closings = frozenset(r.term for r in usual if r.kind == 2)
    ends = Ends(sorted({r.term for r in usual if r.kind == 1} | {c.rpartition(" ")[2] for c in closings}))
    begun = terms.where("kind = 3").select("term", F.col("n").alias("begun"))
    closers = terms.where((F.col("kind") == 2) & F.left("term", F.lit(1)).isin(".", BOUNDARY) & (F.col("n") >= max(CLOSING_TEXTS, CLOSER_SHARE * n_docs))).join(begun, "term", "left")
    # At most 1 / CLOSER_SHARE of them. What begins a known word may be that word cut off.
    closers = frozenset(r.term for r in closers.where("n > coalesce(begun, 0)").select("term").collect() if not ends.begins_known(r.term[2:]))
    known = rows.sparkSession.sparkContext.broadcast((ends, closings))
    made = materialise(parallel(rows.select("text")).mapInArrow(lambda batches: _made(known, batches), "kind tinyint, term string, n bigint, packed binary"), "examples")
    # Beginnings of last lines, shared by several texts, that hardly ever begin a sentence. At most 1 / CLOSING_SHARE of them.
    begins = made.where("kind > 1").groupBy("term").agg(F.sum(F.when(F.col("kind") == 2, F.col("n"))).alias("short"), F.sum(F.when(F.col("kind") == 3, F.col("n"))).alias("long"))
    openings = frozenset(r.term for r in begins.where((F.col("short") >= max(CLOSING_TEXTS, CLOSING_SHARE * n_docs)) & (F.col("short") > 5 * F.coalesce("long", F.lit(0)))).select("term").collect())
    ends.weights = learned(made.where((F.col("kind") == 0) | (F.col("kind") == 1) & F.col("term").isin(list(openings))).select("packed"))
    discard(made)
    shipped = rows.sparkSession.sparkContext.broadcast((ends, closers, openings))

    def judged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ends, closers, openings = shipped.value
        for batch in batches:
            found = []
            for last, opens in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                raw = last if opens else [BOUNDARY, *last]
                found.append(closing_of(raw) not in closers and (opens or not ends.closes(last, openings)))
            doubtful = batch.filter(pa.array(found, pa.bool_()))
            cut = ends.likelihoods(doubtful.column(1).to_pylist(), doubtful.column(2).to_pylist()) > CUT_ABOVE
            kept = doubtful.column(0).filter(pa.array(cut, pa.bool_()))
            yield pa.RecordBatch.from_arrays([kept, pa.array(["goes on"] * len(kept), pa.string())], names=["doc_id", "evidence"])

    by_end = docs.where("last IS NOT NULL").select("doc_id", "last", "opens").mapInArrow(judged, "doc_id bigint, evidence string")
    by_mark = docs.where("evidence IS NOT NULL").select("doc_id", "evidence")

    # Reposts have one length too, so copies of a text count once.
    limits = field_limits(docs.select("source", "chars", "bytes", "widest", "copy").distinct(), least_limit)
    limits = materialise(limits.withColumn("less", F.explode(F.sequence(F.lit(0), "missing"))), "limits")
    limits = bounded(limits.groupBy("source", "unit", (F.col("length") - F.col("less")).alias("length")).agg(F.min("less").alias("less")))
    of = lambda unit: docs.where("may_be").join(limits.where(F.col("unit") == unit).withColumnRenamed("length", unit).select("source", unit, "less"), ["source", unit]).where("widest > less")
    by_limit = of("chars").select("doc_id").union(of("bytes").select("doc_id")).withColumn("evidence", F.lit("limit"))
    marked = F.lit(False)
    for end in MARK_ENDS:
        marked = marked | F.endswith(F.rtrim(F.col("text"), F.lit(" \t\n\r\f\v")), F.lit(end))
    bare = F.rtrim(F.when(marked, F.regexp_replace("text", rf"(?:\s*{CUT_MARKS})+\s*$", "")).otherwise(F.col("text")))
    prefixes = prefixes_of_others(rows.select(bare.alias("text"))).where((F.col("chars") >= prefix_chars) & ~F.col("sentence")).select("bare")
    by_copy = docs.select("doc_id", "bare").join(prefixes, "bare", "left_semi").select("doc_id", F.lit("prefix").alias("evidence"))
    rank = "CASE evidence WHEN 'prefix' THEN 0 WHEN 'limit' THEN 1 ELSE 2 END"
    return by_end.union(by_mark).union(by_limit).union(by_copy).groupBy("doc_id").agg(F.min_by("evidence", F.expr(rank)).alias("evidence"))


def rates(documents: DataFrame, cut: DataFrame) -> DataFrame:
    """(source, n_docs, n_cut, share) for each source, null included."""
    marked = documents.select("doc_id", "source").join(cut.select("doc_id").withColumn("cut", F.lit(1)), "doc_id", "left")
    return marked.groupBy("source").agg(F.count("*").alias("n_docs"), F.count("cut").alias("n_cut"), (F.count("cut") / F.count("*")).alias("share"))
