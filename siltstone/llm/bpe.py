"""Byte-level BPE as a streaming transducer.

Text is cut into pieces by the tokenizer's pattern, which needs two characters of lookahead. Within a piece the last
token of the encoding of every prefix is unique, and two tokens may stand side by side exactly if encoding their
concatenation gives them back; so one pass with back pointers encodes a piece of any length. A token that spans the end
of what was read starts within the longest token's length of it. Hence every continuation's encoding runs through one
of the last ``lookahead`` positions, and what the chains from all of them share is stable and is emitted; only the rest is
kept. ``lookahead`` is computed from the merge list.
"""

from __future__ import annotations

import base64
import codecs
import functools
import os
from collections.abc import Iterable, Iterator

import regex

TOKENIZERS = "/opt/tokenizers"
#: Fixed value: the pattern that cuts text before the merges of the byte-level vocabularies.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Characters after a piece that can still change it.
PIECE_LOOKAHEAD = 2
#: An unfinished piece longer than this is a run of one kind of characters (contractions are shorter).
SURE = 8
#: Characters taken in at a time; an unfinished piece longer than this is encoded as it comes.
CHUNK = 1 << 16
_CACHE = 100_000

_RUNS = (regex.compile(r"\p{L}+"), regex.compile(r"\p{N}+"), regex.compile(r"[^\s\p{L}\p{N}]+"), regex.compile(r"\s+"))


class Merges:
    """A merge list given as byte strings with ranks; ids are the ranks."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.tokens = {r: t for t, r in ranks.items()}
        #: No token is longer, so none that spans a position starts earlier than this before it.
        self.lookahead = max(map(len, ranks))
        self.tails = {t[i:] for t in ranks for i in range(len(t))}
        self.pattern = regex.compile(PATTERN)
        self._beside: dict[tuple[int, int], bool] = {}
        self._pieces: dict[str, tuple[int, ...]] = {}

    def merged(self, data: bytes) -> list[int]:
        """Plain merging, lowest rank first; for short strings."""
        parts = [data[i : i + 1] for i in range(len(data))]
        while len(parts) > 1:
            best, at = None, -1
            for i in range(len(parts) - 1):
                r = self.ranks.get(parts[i] + parts[i + 1])
                if r is not None and (best is None or r < best):
                    best, at = r, i
            if best is None:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return [self.ranks[p] for p in parts]

    def beside(self, a: int, b: int) -> bool:
        """Whether b may follow a; a < 0 asks whether b stands for its own bytes at all."""
        known = self._beside.get((a, b))
        if known is None:
            left = self.tokens[a] if a >= 0 else b""
            known = self.merged(left + self.tokens[b]) == ([a, b] if a >= 0 else [b])
            if len(self._beside) > 4 * _CACHE:
                self._beside.clear()
            self._beside[a, b] = known
        return known

    def piece(self, text: str) -> tuple[int, ...]:
        ids = self._pieces.get(text)
        if ids is None:
            t = PieceEncoder(self)
            ids = tuple([*t.feed(text.encode()), *t.finish()])
            if len(text) <= 64:
                if len(self._pieces) >= _CACHE:
                    self._pieces.clear()
                self._pieces[text] = ids
        return ids


def read(name: str = "byte_bpe_50k", folder: str = TOKENIZERS) -> bytes:
    """A vocabulary file, to be sent along with a job."""
    with open(os.path.join(folder, f"{name}.tiktoken"), "rb") as f:
        return f.read()


@functools.lru_cache(maxsize=4)
def merges_of(vocabulary: bytes) -> Merges:
    return Merges({base64.b64decode(t): int(r) for t, r in map(bytes.split, vocabulary.splitlines()) if t})


def load(name: str = "byte_bpe_50k", folder: str = TOKENIZERS) -> Merges:
    return merges_of(read(name, folder))


class PieceEncoder:
    """Bytes of one piece in, ids out as soon as no continuation can change them."""

    def __init__(self, merges: Merges):
        self.m = merges
        self.data = b""  # not yet emitted, after the last emitted token
        self.before = -1  # the token before data
        self.last: list[int] = []  # last token of the encoding of data[: i + 1]

    def feed(self, data: bytes) -> list[int]:
        m, start = self.m, len(self.data)
        self.data += data
        for end in range(start + 1, len(self.data) + 1):
            found = None
            for size in range(1, min(m.lookahead, end) + 1):
                tail = self.data[end - size : end]
                if tail not in m.tails:
                    break
                t = m.ranks.get(tail)
                if t is not None:
                    prev = self.last[end - size - 1] if size < end else self.before
                    if m.beside(prev, t) and m.beside(-1, t):
                        found = t
            if found is None:
                raise ValueError(f"no token ends with {self.data[end - 8 : end]!r}")
            self.last.append(found)
        return self._emit(self._stable()) if len(self.data) > 4 * m.lookahead else []

    def _size(self, position: int) -> int:
        return len(self.m.tokens[self.last[position - 1]])

    def _stable(self) -> int:
        """The furthest position that the chains of all open positions share."""
        n = len(self.data)
        open_at = set(range(max(0, n - self.m.lookahead + 1), n + 1))
        while len(open_at) > 1:
            far = max(open_at)
            open_at.remove(far)
            open_at.add(far - self._size(far))
        return open_at.pop()

    def _emit(self, upto: int) -> list[int]:
        ids, at = [], upto
        while at > 0:
            ids.append(self.last[at - 1])
            at -= self._size(at)
        ids.reverse()
        if ids:
            self.before = ids[-1]
        self.data, self.last = self.data[upto:], self.last[upto:]
        return ids

    def finish(self) -> list[int]:
        return self._emit(len(self.data))


class TextEncoder:
    """Text in chunks in, ids out; memory does not grow with the text."""

    def __init__(self, merges: Merges, chunk: int = CHUNK):
        self.m, self.chunk = merges, chunk
        self.rest = ""
        self.open: PieceEncoder | None = None  # of a piece whose head is already encoded
        self.run = _RUNS[0]

    def feed(self, text: str, last: bool = False) -> list[int]:
        ids: list[int] = []
        self.rest += text
        if self.open and not self._continue(ids, last):
            return ids
        at, buffer, pieces, piece = 0, self.rest, self.m._pieces, self.m.piece
        if last:  # nothing can change any piece
            for w in self.m.pattern.findall(buffer):
                ids.extend(pieces.get(w) or piece(w))
            self.rest = ""
            return ids
        limit = len(buffer) - PIECE_LOOKAHEAD
        for m in self.m.pattern.finditer(buffer):
            end = m.end()
            if end > limit:
                break
            w = m[0]
            ids.extend(pieces.get(w) or piece(w))
            at = end
        self.rest = buffer[at:]
        if len(self.rest) > max(self.chunk, SURE):
            head = self.rest[1] if self.rest[0] == " " and not self.rest[1].isspace() else self.rest[0]
            self.run = next(r for r in _RUNS if r.match(head))
            cut = len(self.rest) - PIECE_LOOKAHEAD
            self.open = PieceEncoder(self.m)
            ids += self.open.feed(self.rest[:cut].encode())
            self.rest = self.rest[cut:]
        return ids

    def _continue(self, ids: list[int], last: bool) -> bool:
        """Takes in more of the open piece; true when it has ended."""
        m = self.run.match(self.rest)
        end = m.end() if m else 0
        if end == len(self.rest) and not last:
            keep = max(0, end - PIECE_LOOKAHEAD)
            ids += self.open.feed(self.rest[:keep].encode())
            self.rest = self.rest[keep:]
            return False
        if self.run is _RUNS[3] and end and end < len(self.rest):
            end -= 1  # white space before a word leaves its last character to what follows
        ids += self.open.feed(self.rest[:end].encode())
        ids += self.open.finish()
        self.open, self.rest = None, self.rest[end:]
        return True

    def finish(self) -> list[int]:
        return self.feed("", last=True)


def encode(text: str | None, merges: Merges, chunk: int = CHUNK) -> list[int]:
    """Ids of a text without special tokens; none for an empty or null text."""
    if not text:
        return []
    t = TextEncoder(merges, chunk)
    ids: list[int] = []
    for i in range(0, len(text), chunk):
        ids += t.feed(text[i : i + chunk], last=i + chunk >= len(text))
    return ids


def decode(ids: Iterable[int], merges: Merges) -> Iterator[str]:
    """Text of ids, piece by piece: bytes of an unfinished character wait in the decoder's state."""
    state = codecs.getincrementaldecoder("utf-8")(errors="strict")
    for i in ids:
        s = state.decode(merges.tokens[i])
        if s:
            yield s
    s = state.decode(b"", final=True)
    if s:
        yield s
