"""Byte-pair encoding of whole columns by a lazily determinised finite-state transducer, and streaming decoding.

A byte-pair encoding is valid exactly if each of its tokens and each pair of neighbours encodes to itself. Hence the
encoding of every prefix has one last token, which depends only on the tokens that end there and on the last token before
each of them. A state of the transducer is the longest suffix of the input that some token may still extend, with the
encodings of the prefixes that end within it; a token is emitted as soon as all of these agree on it, so the lookahead is
bounded by the longest token. States and transitions are made when an input first needs them and then kept.
"""

from __future__ import annotations

import base64
from collections.abc import Iterable, Iterator
from pathlib import Path

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kvflow.session import parallel

#: Folder with the vocabulary files of public tokenizers.
TOKENIZERS = "/opt/tokenizers"
# Fixed value: the pattern by which byte_bpe_50k cuts a text before merging.
PRETOKEN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: States, pretokens with their ids, and pairs of tokens tried, that a worker keeps before it starts afresh.
MOST_STATES = 400_000
MOST_MEMO = 400_000
MOST_PAIRS = 1_000_000
END = 256
_loaded: dict[int, Transducer] = {}


def vocabulary_file(name: str = "byte_bpe_50k", folder: str = TOKENIZERS) -> bytes:
    """The file of a byte-level vocabulary: base64 bytes and rank on each line. Under 2 MB whatever the data."""
    return Path(folder, f"{name}.tiktoken").read_bytes()


def read_ranks(file: bytes) -> dict[bytes, int]:
    return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in file.splitlines() if line)}


class Transducer:
    def __init__(self, ranks: dict[bytes, int], pretoken: str = PRETOKEN):
        self.ranks = ranks
        self.tokens = {rank: token for token, rank in ranks.items()}
        self.prefixes = {token[:i] for token in ranks for i in range(len(token))}
        self.pattern = regex.compile(pretoken)
        self.compatible: dict[tuple[int, int], bool] = {}
        self.memo: dict[str, tuple[int, ...]] = {}
        self._fresh()

    def _fresh(self) -> None:
        #: (last emitted token or -1, live suffix, encodings of the prefixes that end within it).
        self.states: list[tuple[int, bytes, tuple[tuple[int, ...], ...]]] = [(-1, b"", ((),))]
        self.numbers = {self.states[0]: 0}
        self.moves: dict[int, tuple[int, tuple[int, ...]]] = {}

    def merged(self, data: bytes) -> list[int]:
        """The encoding by its definition: the pair of least rank is merged until none is left."""
        parts = [data[i : i + 1] for i in range(len(data))]
        while len(parts) > 1:
            rank, at = min((self.ranks.get(parts[i] + parts[i + 1], 1 << 62), i) for i in range(len(parts) - 1))
            if rank == 1 << 62:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return [self.ranks[p] for p in parts]

    def _fits(self, before: int, token: int) -> bool:
        known = self.compatible.get((before, token))
        if known is None:
            left = self.tokens[before] if before >= 0 else b""
            known = self.merged(left + self.tokens[token]) == ([before, token] if before >= 0 else [token])
            if len(self.compatible) >= MOST_PAIRS:
                self.compatible.clear()
            self.compatible[before, token] = known
        return known

    def _move(self, state: int, byte: int) -> tuple[int, tuple[int, ...]]:
        emitted, live, chains = self.states[state]
        if byte == END:
            return 0, chains[-1]
        text = live + bytes((byte,))
        for start in range(len(text)):
            token = self.ranks.get(text[start:])
            if token is not None and self._fits(chains[start][-1] if chains[start] else emitted, token):
                chains += ((*chains[start], token),)
                break
        else:
            raise ValueError("the vocabulary can't encode this text")
        cut = next(i for i in range(len(text) + 1) if text[i:] in self.prefixes)
        chains = chains[cut:]
        agreed = 0
        shortest = min(map(len, chains))
        while agreed < shortest and len({c[agreed] for c in chains}) == 1:
            agreed += 1
        out = chains[0][:agreed]
        after = (out[-1] if out else emitted, text[cut:], tuple(c[agreed:] for c in chains))
        number = self.numbers.get(after)
        if number is None:
            number = self.numbers[after] = len(self.states)
            self.states.append(after)
        return number, out

    def transduce(self, data: Iterable[int]) -> Iterator[int]:
        """Tokens of one pretoken's bytes, each as soon as it is certain."""
        if len(self.states) > MOST_STATES:
            self._fresh()
        state, moves = 0, self.moves
        for byte in (*data, END):
            key = state * 257 + byte
            move = moves.get(key)
            if move is None:
                move = moves[key] = self._move(state, byte)
            state, out = move
            yield from out

    def encode(self, text: str | None) -> list[int]:
        """Ids of a text without special tokens; null and empty texts have none."""
        ids: list[int] = []
        if not text:
            return ids
        memo = self.memo
        for piece in self.pattern.findall(text):
            found = memo.get(piece)
            if found is None:
                found = tuple(self.transduce(piece.encode("utf-8")))
                if len(piece) < 64:
                    if len(memo) >= MOST_MEMO:
                        memo.clear()
                    memo[piece] = found
            ids.extend(found)
        return ids

    def decode(self, ids: Iterable[int]) -> str:
        return "".join(self.decode_stream(ids))

    def decode_stream(self, ids: Iterable[int]) -> Iterator[str]:
        """The characters that each id completes."""
        machine = Utf8()
        for i in ids:
            yield machine.feed(self.tokens[i])
        yield machine.end()


class Utf8:
    """Incremental UTF-8: a state is the bytes still expected and the range of the next one. What is no UTF-8 becomes U+FFFD."""

    def __init__(self) -> None:
        self.need, self.low, self.high, self.code = 0, 0x80, 0xBF, 0

    def feed(self, data: bytes) -> str:
        out = []
        for b in data:
            if self.need:
                if self.low <= b <= self.high:
                    self.code = self.code << 6 | b & 0x3F
                    self.need, self.low, self.high = self.need - 1, 0x80, 0xBF
                    if not self.need:
                        out.append(chr(self.code))
                    continue
                out.append("�")
                self.need, self.low, self.high = 0, 0x80, 0xBF
            if b < 0x80:
                out.append(chr(b))
            elif 0xC2 <= b <= 0xF4:
                self.need = 1 + (b >= 0xE0) + (b >= 0xF0)
                self.code = b & (0x1F, 0x0F, 0x07)[self.need - 1]
                self.low = {0xE0: 0xA0, 0xF0: 0x90}.get(b, 0x80)
                self.high = {0xED: 0x9F, 0xF4: 0x8F}.get(b, 0xBF)
            else:
                out.append("�")
        return "".join(out)

    def end(self) -> str:
        left, self.need = "�" if self.need else "", 0
        return left


def transducer(file: bytes) -> Transducer:
    """The worker's transducer of a vocabulary; it is kept between tasks with what it has determinised."""
    key = hash(file)
    if key not in _loaded:
        _loaded[key] = Transducer(read_ranks(file))
    return _loaded[key]


def encode(df: DataFrame, key: str, text: str, vocabulary: bytes | None = None) -> DataFrame:
    """(key, ids ARRAY<INT>), one row per row of df: the ids of text without special tokens.

    Null and empty texts give the empty list; repeated rows are encoded each; other columns are not read. The vocabulary
    is broadcast: its size is that of its file, whatever the data.
    """
    file = df.sparkSession.sparkContext.broadcast(vocabulary or vocabulary_file())
    kind = df.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode_one = transducer(file.value).encode
        for batch in batches:
            ids = pa.array([encode_one(t) for t in batch.column(1).to_pylist()], pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([batch.column(0), ids], names=[key, "ids"])

    return parallel(df.select(F.col(key), F.col(text))).mapInArrow(run, f"`{key}` {kind}, ids array<int>")


def with_sizes(df: DataFrame, text: str, name: str = "n_tokens", vocabulary: bytes | None = None) -> DataFrame:
    """df without text but with the number of its tokens, BIGINT; 0 for null and empty texts."""
    file = df.sparkSession.sparkContext.broadcast(vocabulary or vocabulary_file())
    keep = [c for c in df.columns if c != text]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode_one = transducer(file.value).encode
        for batch in batches:
            sizes = pa.array([len(encode_one(t)) for t in batch.column(len(keep)).to_pylist()], pa.int64())
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], sizes], names=[*keep, name])

    schema = ", ".join(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in keep) + f", `{name}` bigint"
    return parallel(df.select(*[F.col(f"`{c}`") for c in keep], F.col(f"`{text}`"))).mapInArrow(run, schema)
