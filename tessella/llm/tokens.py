"""Encoding of a corpus by a public byte-level BPE vocabulary.

Every text goes through a transducer that holds a bounded piece of it.  A cut
between a non-blank and a blank character, or between a letter and a digit, is
final as soon as it is seen: the split pattern never joins the two.  Inside a
run that has no such cut, a token leaves once the merge list's lookahead
(`Vocabulary.lookahead`, computed from the list) has been read behind it.  So
beside the value of the row itself and its list of ids, what is held is a block
and the lookahead, whatever the length of the text.  Merges are done here, piece
by piece, and remembered; the public library is what the tests compare with.

Null and empty texts have no tokens; blank text is encoded as it stands; text
that looks like a special token is plain text.
"""

from __future__ import annotations

import base64
import codecs
import heapq
import os
import re
import unicodedata
from array import array
from collections.abc import Iterable, Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..tables import spread

TOKENIZERS = "/opt/tokenizers"
# Fixed value: the split pattern that the vocabulary was made with.
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
BLOCK = 1 << 16
ROWS = 1000


def read_ranks(folder: str = TOKENIZERS, name: str = "byte_bpe_50k") -> dict[bytes, int]:
    with open(os.path.join(folder, f"{name}.tiktoken"), "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


@lru_cache(maxsize=4)
def load(folder: str = TOKENIZERS, name: str = "byte_bpe_50k") -> Vocabulary:
    return Vocabulary(read_ranks(folder, name))


class Vocabulary:
    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.bytes_of = {i: b for b, i in ranks.items()}
        self.pieces = _Pieces(self)

    def halves(self, token: bytes) -> list[bytes]:
        """The two tokens that a token is merged from: what its bytes are when every earlier merge is done.  A token that
        merges never reach has other than two; it stands in no encoding but its own."""
        return self._merged(token, self.ranks[token])

    def _merged(self, data: bytes, below: int) -> list[bytes]:
        """Tokens of `data` under the merges that come before number `below`: again and again the first of the list that
        applies, at its leftmost place."""
        ranks, n = self.ranks, len(data)
        if n < 400:
            parts = [data[i:i + 1] for i in range(n)]
            while len(parts) > 1:
                best, at = below, -1
                for i in range(len(parts) - 1):
                    r = ranks.get(parts[i] + parts[i + 1], below)
                    if r < best:
                        best, at = r, i
                if at < 0:
                    break
                parts[at:at + 2] = [parts[at] + parts[at + 1]]
            return parts
        # The same with a heap over a linked list, in time n log n.
        end = list(range(1, n + 1))  # of the token that begins at i
        before = list(range(-1, n - 1))
        heap = [(r, i, 2) for i in range(n - 1) if (r := ranks.get(data[i:i + 2], below)) < below]
        heapq.heapify(heap)
        gone = bytearray(n + 1)
        while heap:
            _, i, width = heapq.heappop(heap)
            if gone[i] or (mid := end[i]) >= n or end[mid] != i + width:
                continue
            gone[mid] = 1
            end[i] = end[mid]
            if end[i] < n:
                before[end[i]] = i
                if (r := ranks.get(data[i:end[end[i]]], below)) < below:
                    heapq.heappush(heap, (r, i, end[end[i]] - i))
            if (p := before[i]) >= 0 and (r := ranks.get(data[p:end[i]], below)) < below:
                heapq.heappush(heap, (r, p, end[i] - p))
        out, i = [], 0
        while i < n:
            out.append(data[i:end[i]])
            i = end[i]
        return out

    def merge(self, data: bytes) -> list[int]:
        """Ids of one piece."""
        if (whole := self.ranks.get(data)) is not None:
            return [whole]
        return [self.ranks[t] for t in self._merged(data, len(self.ranks) + 1)]

    @property
    def lookahead(self) -> int:
        if not hasattr(self, "_lookahead"):
            merges = (self.halves(t) for t, _ in sorted(self.ranks.items(), key=lambda x: x[1]) if len(t) > 1)
            self._lookahead = lookahead([(h[0], h[1]) for h in merges if len(h) == 2])
        return self._lookahead


def lookahead(merges: list[tuple[bytes, bytes]]) -> int:
    """Bytes after which a token can't change any more, whatever follows.

    Compare the tokens of a text with those of a longer one that begins with it.  Going down the list, the first place
    where the two differ begins at the text's end.  A merge (u, v) moves it to the left only if v ends there, by the length
    of v, and to the end of u; the next one to move it comes later in the list, and its own v ends where u ends, so that one
    of the two is a suffix of the other.  What is sufficient is the greatest sum of lengths of v along such a chain, and the
    token that then spans the place (compare Berglund and van der Merwe 2023)."""
    of_u: dict[bytes, int] = {}  # greatest sum of a chain that ends with this u
    of_end: dict[bytes, int] = {}  # and with a u that has this suffix
    most = longest = 0
    for u, v in merges:
        best = len(v) + max((of_u.get(v[k:], 0) for k in range(len(v))), default=0)
        best = max(best, len(v) + of_end.get(v, 0))
        of_u[u] = max(best, of_u.get(u, 0))
        for k in range(len(u)):
            of_end[u[k:]] = max(best, of_end.get(u[k:], 0))
        most, longest = max(most, best), max(longest, len(u) + len(v))
    return most + longest


class RunEncoder:
    """Merge-list encoding of one run, fed in pieces: of a block and the lookahead, the tokens before the lookahead leave.

    What follows a token's end is encoded alike on its own, for no merge ever crossed that place."""

    def __init__(self, vocabulary: Vocabulary, block: int = BLOCK):
        self.v, self.data, self.block = vocabulary, bytearray(), block

    def feed(self, piece: bytes) -> list[int]:
        out: list[int] = []
        for at in range(0, len(piece), self.block):
            self.data += piece[at:at + self.block]
            if len(self.data) > self.block + self.v.lookahead:
                final, n = len(self.data) - self.v.lookahead, 0
                for i in self.v.merge(bytes(self.data)):
                    if n + len(self.v.bytes_of[i]) > final:
                        break
                    n += len(self.v.bytes_of[i])
                    out.append(i)
                del self.data[:n]
        return out

    def finish(self) -> list[int]:
        out = self.v.merge(bytes(self.data)) if self.data else []
        self.data.clear()
        return out


_FINAL_CUT = regex.compile(r"(?<=\S)(?=\s)|(?<=\p{L})(?=[^\s\p{L}])|(?<=\p{N})(?=[^\s\p{N}])")
_KINDS = {k: regex.compile(p) for k, p in (("letters", r"\p{L}+"), ("digits", r"\p{N}+"), ("blanks", r"\s+"), ("signs", r"[^\s\p{L}\p{N}]+"))}


_SPLIT = regex.compile(PATTERN)


class Transducer:
    """Ids of a text that comes in pieces, in bounded memory."""

    def __init__(self, vocabulary: Vocabulary, block: int = BLOCK):
        self.v, self.block, self.held, self.run, self.kind = vocabulary, block, "", None, ""

    def feed(self, piece: str, last: bool = False) -> Iterable[int]:
        if last and self.run is None and not self.held and len(piece) <= self.block:
            return self._pieces(piece)
        self.held += piece
        out: list[int] = []
        while self.held:
            if self.run is not None:
                m = _KINDS[self.kind].match(self.held)
                k = m.end() if m else 0
                open_end = k == len(self.held) and not last
                if self.kind == "blanks" and k and (k < len(self.held) or not last):
                    k -= 1  # the last blank may belong to what follows
                out += self.run.feed(self.held[:k].encode())
                self.held = self.held[k:]
                if open_end:
                    break
                out += self.run.finish()
                self.run = None
            elif len(self.held) <= self.block:
                break
            elif cut := self._cut():
                out.extend(self._pieces(self.held[:cut]))
                self.held = self.held[cut:]
            elif (k := _SPLIT.match(self.held).end()) < len(self.held) - 1:
                out.extend(self._pieces(self.held[:k]))
                self.held = self.held[k:]
            else:
                self._start_run()
        if last:
            if self.run is not None:
                out += self.run.finish()
                self.run = None
            out.extend(self._pieces(self.held))
            self.held = ""
        return out

    def _pieces(self, text: str) -> Iterator[int]:
        """Ids of a text whose ends are final cuts."""
        split = _SPLIT if _SLOW_CHARS.search(text) else _FAST
        return chain.from_iterable(map(self.v.pieces.__getitem__, split.findall(text)))

    def _cut(self) -> int:
        half = max(1, self.block // 2)
        if m := _FINAL_CUT.search(self.held, half):
            return m.start()
        at = 0
        for m in _FINAL_CUT.finditer(self.held, 1, half + 1):
            at = m.start()
        return at if at < len(self.held) else 0

    def _start_run(self) -> None:
        """Without a final cut the held text is one run, after a blank or some signs at most."""
        text, out = self.held, b""
        if text[0] == " " and not text[1].isspace():
            out, text = b" ", text[1:]
        self.kind = next(k for k, p in _KINDS.items() if p.match(text))
        self.run = RunEncoder(self.v, self.block)
        self.run.feed(out)
        self.held = text


def encode_stream(pieces: Iterable[str], vocabulary: Vocabulary, block: int = BLOCK) -> Iterator[list[int]]:
    t = Transducer(vocabulary, block)
    for p in pieces:
        yield t.feed(p)
    yield t.feed("", last=True)


# The split pattern in the classes of the standard library, which is several times as fast, for texts on whose characters
# both agree: no control characters that only one counts as blank, no numerals that only one counts as letters, and no
# planes or blocks where the Unicode versions of the two may differ.
_FAST = re.compile(r"'(?:[sdmt]|ll|ve|re)| ?[^\W\d_]+| ?\d+| ?[^\w\s]+(?:_|[^\w\s])*| ?_(?:_|[^\w\s])*|\s+(?!\S)|\s+")
_SLOW_CHARS = re.compile("[\x1c-\x1f\u0870-\u08ff\u1c80-\u1cbf\ua7c0-\ua7ff\U00010000-\U0010ffff" + "".join(re.escape(chr(c)) for c in range(0x80, 0x10000) if unicodedata.category(chr(c)) in ("No", "Nl", "Cn")) + "]")
_REMEMBERED, _SHORT = 300_000, 40


class _Pieces(dict):
    """Ids of a split piece, remembered up to a bound."""

    def __init__(self, vocabulary: Vocabulary):
        super().__init__()
        self.vocabulary = vocabulary

    def __missing__(self, piece: str) -> list[int]:
        ids = self.vocabulary.merge(piece.encode("utf-8"))
        if len(self) < _REMEMBERED and len(piece) <= _SHORT:
            self[piece] = ids
        return ids


def encode_into(out: array, text: str | None, vocabulary: Vocabulary, block: int = BLOCK) -> None:
    """Appends the ids of `text` to `out`, block by block as they leave the transducer."""
    if not text:
        return
    t, n = Transducer(vocabulary, block), len(text)
    for at in range(0, n, block):
        out.extend(t.feed(text[at:at + block], last=at + block >= n))


def encode(text: str | None, vocabulary: Vocabulary, block: int = BLOCK) -> list[int]:
    out = array("i")
    encode_into(out, text, vocabulary, block)
    return out.tolist()


def decode_stream(ids: Iterable[int], vocabulary: Vocabulary) -> Iterator[str]:
    """The text of `ids`, character by character as its bytes are complete; broken bytes become U+FFFD."""
    machine = codecs.getincrementaldecoder("utf-8")("replace")
    for i in ids:
        if s := machine.decode(vocabulary.bytes_of[i]):
            yield s
    if s := machine.decode(b"", True):
        yield s


_SHIPPED: dict[str, Vocabulary] = {}


def _shipped(b, name: str) -> Vocabulary:
    """The broadcast vocabulary, made once in each worker process."""
    if name not in _SHIPPED:
        _SHIPPED[name] = Vocabulary(b.value)
    return _SHIPPED[name]


def encode_corpus(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", tokenizers: str = TOKENIZERS, name: str = "byte_bpe_50k") -> DataFrame:
    """(id, ids) of every row of `df`, in one narrow stage; null and empty texts have an empty list, repeated rows stay
    repeated, and other columns are not read.  The vocabulary (a fixed table of some 50,000 tokens) is read by the driver
    and broadcast, so that executors need no files."""
    kind = df.schema[id_col].dataType.simpleString()
    ranks, key = df.sparkSession.sparkContext.broadcast(read_ranks(tokenizers, name)), f"{tokenizers}/{name}"

    def run(batches):
        v = _shipped(ranks, key)
        for b in batches:
            for at in range(0, len(b), ROWS):
                part = b.slice(at, ROWS)
                flat, ends = array("i"), [0]
                for t in part.column(1):
                    encode_into(flat, t.as_py(), v)
                    ends.append(len(flat))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.frombuffer(flat, np.int32) if flat else np.empty(0, np.int32)))], [id_col, "ids"])

    return spread(df.select(F.col(id_col), F.col(text_col))).mapInArrow(run, f"`{id_col}` {kind}, ids array<int>")


def decode_corpus(df: DataFrame, id_col: str = "doc_id", ids_col: str = "ids", tokenizers: str = TOKENIZERS, name: str = "byte_bpe_50k") -> DataFrame:
    """(id, text) of every row of `df`: the ids read back by the byte-to-text machine; null and empty lists give empty texts."""
    kind = df.schema[id_col].dataType.simpleString()
    ranks, key = df.sparkSession.sparkContext.broadcast(read_ranks(tokenizers, name)), f"{tokenizers}/{name}"

    def run(batches):
        v = _shipped(ranks, key)
        for b in batches:
            texts = ["".join(decode_stream(x.as_py() or (), v)) for x in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(texts, pa.string())], [id_col, "text"])

    return df.select(F.col(id_col), F.col(ids_col)).mapInArrow(run, f"`{id_col}` {kind}, text string")
