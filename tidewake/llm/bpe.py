"""Byte-level BPE: pre-tokenisation by class arrays and transition-function scans, cached merging.

The pre-tokeniser works on the code points of many texts at once. Each gets a symbol (letter, number,
other, space that joins what follows, last or inner white space, apostrophe of a contraction). An
automaton of eight states then says where tokens begin. Its transition functions compose
associatively, so blocks are reduced to functions side by side (numbers of a small monoid), the block functions are combined by a
doubling scan, and each block is run again from its known first state. No regular expression is used.

Slices between boundaries go through a bounded cache to pair merging, either by a rank table
(``RankEncoder``) or by the tokenizers library (``LibraryEncoder``), which sees each distinct slice. Slices are looked up
as numbers, and the ids of all are gathered in one step.
"""

from __future__ import annotations

import base64
import functools
import heapq
import os
import re
import unicodedata
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np

#: Unicode's White_Space property (fixed values).
WHITE = [*range(0x09, 0x0E), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]

LETTER, NUMBER, OTHER, JOINING, LAST_WHITE, WHITE_RUN, APOS1, APOS2, END = range(9)
FRESH, IN_LETTERS, IN_NUMBERS, IN_OTHER, JOINED, IN_WHITE, ONE_LEFT, TWO_LEFT = range(8)
STATES, SYMBOLS = 8, 9
BLOCK = 256
#: Code points of one round of the scan; a longer text makes a round of its own.
CHUNK = 1 << 20


def _automaton() -> tuple[np.ndarray, np.ndarray]:
    """Next state and whether a token begins, by (symbol, state)."""
    step, starts = np.zeros((SYMBOLS, STATES), np.uint8), np.ones((SYMBOLS, STATES), bool)
    step[LETTER], step[NUMBER], step[OTHER] = IN_LETTERS, IN_NUMBERS, IN_OTHER
    step[JOINING], step[LAST_WHITE], step[WHITE_RUN], step[END] = JOINED, FRESH, IN_WHITE, FRESH
    step[APOS1], step[APOS2] = ONE_LEFT, TWO_LEFT
    for symbol, state in ((LETTER, IN_LETTERS), (NUMBER, IN_NUMBERS), (OTHER, IN_OTHER), (WHITE_RUN, IN_WHITE)):
        starts[symbol, state] = False
    for symbol in (LETTER, NUMBER, OTHER, APOS1, APOS2):
        starts[symbol, JOINED] = False
    for symbol in (APOS1, APOS2):  # inside punctuation or after a joining space it is punctuation
        starts[symbol, IN_OTHER] = False
        step[symbol, [IN_OTHER, JOINED]] = IN_OTHER
    starts[LETTER, [ONE_LEFT, TWO_LEFT]] = False
    step[LETTER, ONE_LEFT], step[LETTER, TWO_LEFT] = FRESH, ONE_LEFT
    return step.ravel(), starts.ravel()


STEP, STARTS = _automaton()


def _monoid() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All functions of states that strings of symbols make (there are few), as numbers: the number of each
    function and symbol after it, the number of two functions one after the other, and what each makes of FRESH."""
    symbols = [tuple(STEP[k * STATES : (k + 1) * STATES].tolist()) for k in range(SYMBOLS)]
    found = [tuple(range(STATES))]
    for f in found:  # grows as it goes
        for g in symbols:
            if (h := tuple(g[x] for x in f)) not in found:
                found.append(h)
    number = {f: k for k, f in enumerate(found)}
    then = [[number[tuple(g[x] for x in f)] for g in symbols] for f in found]
    both = [[number[tuple(g[x] for x in f)] for g in found] for f in found]
    return np.array(then, np.uint8).ravel(), np.array(both, np.uint8), np.array([f[FRESH] for f in found], np.uint8)


THEN, BOTH, FROM_FRESH = _monoid()


@functools.cache
def _classes() -> np.ndarray:
    """LETTER, NUMBER, OTHER or WHITE_RUN by code point."""
    kinds = {"L": LETTER, "N": NUMBER}
    out = np.fromiter((kinds.get(unicodedata.category(chr(c))[0], OTHER) for c in range(0x110000)), np.uint8, 0x110000)
    out[WHITE] = WHITE_RUN
    return out


def _symbols(points: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """The symbol of each code point; ``ends`` are the places of the marks between texts."""
    out = _classes()[points]
    out[ends] = END
    white = out == WHITE_RUN
    follows = np.zeros(len(out), bool)  # a character that isn't white space follows
    follows[:-1] = ~white[1:] & (out[1:] != END)
    last = white & follows
    out[last] = np.where(points[last] == 0x20, JOINING, LAST_WHITE)
    at = np.flatnonzero((points == 0x27) & (out == OTHER))
    if len(at):
        far = np.append(points, np.zeros(2, points.dtype))
        a, b = far[at + 1], far[at + 2]
        out[at[np.isin(a, [ord(c) for c in "stmd"])]] = APOS1
        two = ((a == ord("r")) & (b == ord("e"))) | ((a == ord("v")) & (b == ord("e"))) | ((a == ord("l")) & (b == ord("l")))
        out[at[two]] = APOS2
    return out


def _scan(symbols: np.ndarray) -> np.ndarray:
    """Whether a token begins at each place."""
    blocks = -(-len(symbols) // BLOCK)
    padded = np.full(blocks * BLOCK, END, np.uint8)
    padded[: len(symbols)] = symbols
    lanes = np.ascontiguousarray(padded.reshape(blocks, BLOCK).T)
    whole = np.zeros(blocks, np.uint8)  # the function of each block, from the identity on
    for lane in lanes:
        whole = THEN.take(whole * np.uint8(SYMBOLS) + lane)
    span = 1  # whole[i] becomes the composition of all functions up to block i
    while span < blocks:
        whole[span:] = BOTH[whole[:-span], whole[span:]]
        span *= 2
    state = np.zeros(blocks, np.uint8)
    state[1:] = FROM_FRESH[whole[:-1]]
    begins = np.empty((BLOCK, blocks), bool)
    for k, lane in enumerate(lanes):
        at = lane * np.uint8(STATES) + state
        STARTS.take(at, out=begins[k])
        state = STEP.take(at)
    return begins.T.ravel()[: len(symbols)]


@dataclass
class Slices:
    """All texts as one string with a NUL after each, and its pre-tokens: where they begin and end in code points and
    in bytes, which of them are one space and letters, and how many come before each text (one more than texts)."""

    joined: str
    data: bytes
    begin: np.ndarray
    stop: np.ndarray
    first: np.ndarray
    after: np.ndarray
    words: np.ndarray
    before: np.ndarray

    def texts(self, which: np.ndarray) -> list[str]:
        return [self.joined[a:b] for a, b in zip(self.begin[which].tolist(), self.stop[which].tolist(), strict=True)]


def pre_tokens(texts: list[str]) -> Slices:
    joined = "\0".join(texts) + "\0"
    points = np.frombuffer(joined.encode("utf-32-le"), np.uint32)
    lengths = np.fromiter(map(len, texts), np.int64, len(texts))
    ends = np.cumsum(lengths + 1) - 1
    symbols = _symbols(points, ends)
    begins = np.flatnonzero(_scan(symbols))
    width = 1 + (points >= 0x80).astype(np.int64) + (points >= 0x800) + (points >= 0x10000)
    offset = np.cumsum(width) - width
    real = np.flatnonzero(symbols[begins] != END)
    begin, stop = begins[real], begins[real + 1]
    before = np.zeros(len(texts) + 1, np.int64)
    before[1:] = np.searchsorted(begin, ends)
    words = (symbols[begin] == JOINING) & (symbols[np.minimum(begin + 1, len(symbols) - 1)] == LETTER)
    return Slices(joined, joined.encode(), begin, stop, offset[begin], offset[stop], words, before)


#: Odd multipliers by which slices are told apart (fixed values).
MULTIPLIERS = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x165667B19E3779F9))
TOP = np.uint64(1 << 63)


def _scrambled(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * MULTIPLIERS[0]
    x = (x ^ (x >> np.uint64(29))) * MULTIPLIERS[1]
    return x ^ (x >> np.uint64(32))


def _keys(data: bytes, first: np.ndarray, after: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two numbers for each slice. Up to seven bytes the first holds the slice itself and its length; up to sixteen
    both are hashes of its first and last eight bytes, beyond of the whole."""
    padded = np.frombuffer(data + bytes(8), np.uint8)
    at = np.ndarray(len(data), "<u8", padded, strides=(1,))
    length = (after - first).astype(np.uint64)
    head, short = at[first], length <= 7
    mask = (np.uint64(1) << (np.minimum(length, 7) * np.uint64(8)).astype(np.uint64)) - np.uint64(1)
    key = (head & mask) | (length << np.uint64(56))
    check = length.copy()
    far = np.flatnonzero(~short)
    if len(far):
        a, b, n = head[far], at[after[far] - 8], length[far]
        key[far] = _scrambled(a * MULTIPLIERS[1] ^ _scrambled(b ^ n * MULTIPLIERS[2])) | TOP
        check[far] = _scrambled(b * MULTIPLIERS[2] ^ _scrambled(a ^ n * MULTIPLIERS[0]))
        for k in far[n > 16].tolist():
            piece = data[first[k] : after[k]]
            key[k] = np.uint64(hash(piece) & (1 << 64) - 1) | TOP
            check[k] = zlib.crc32(piece) << 32 | zlib.adler32(piece)
    return key, check


class Encoder:
    """Texts to ids, by whatever ``_fill`` says of each slice.

    The cache has a number for each slice and a pool of ids: the distinct slices of a round are looked up, and all ids
    are then gathered at once. Slices that disagree in the second number although they agree in the first (two
    different ones that collide) make all slices of their round be merged anew. The cache starts anew when it is full.
    """

    most = 700_000

    def __init__(self) -> None:
        self._clear()

    def _clear(self) -> None:
        self.index: dict[int, int] = {}
        self.checks, self.starts, self.counts = np.zeros(1 << 16, np.uint64), np.zeros(1 << 16, np.int64), np.zeros(1 << 16, np.int64)
        self.pool, self.filled = np.zeros(1 << 18, np.uint32), 0

    def _fill(self, slices: Slices, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of these slices one after the other, and how many each has."""
        raise NotImplementedError

    def _add(self, keys: np.ndarray, checks: np.ndarray, slices: Slices, which: np.ndarray) -> np.ndarray:
        ids, counts = self._fill(slices, which)
        n, more = len(self.index), len(which)
        while n + more > len(self.checks):
            self.checks, self.starts, self.counts = (np.concatenate([x, np.zeros_like(x)]) for x in (self.checks, self.starts, self.counts))
        while self.filled + len(ids) > len(self.pool):
            self.pool = np.concatenate([self.pool, np.zeros_like(self.pool)])
        self.checks[n : n + more], self.counts[n : n + more] = checks, counts
        self.starts[n : n + more] = self.filled + np.cumsum(counts) - counts
        self.pool[self.filled : self.filled + len(ids)] = ids
        self.filled += len(ids)
        self.index.update(zip(keys.tolist(), range(n, n + more), strict=True))
        return np.arange(n, n + more)

    def encode(self, texts: list[str]) -> list[bytes]:
        """The ids of each text, as little-endian unsigned 32-bit bytes."""
        return [x for part in _rounds(texts) for x in self._encoded(pre_tokens(part))[0]]

    def encode_with_offsets(self, texts: list[str]) -> list[tuple[bytes, np.ndarray]]:
        """The ids of each text and the byte at which each id's part of the text's UTF-8 form begins."""
        out = []
        for part in _rounds(texts):
            slices = pre_tokens(part)
            found, counts = self._encoded(slices)
            ids = np.frombuffer(b"".join(found), "<u4").astype(np.int64)
            # Within a slice, ids begin where those before them end; each slice begins where it stands.
            width = self.id_widths[ids]
            own = np.append(0, np.cumsum(width))
            begins = own[:-1] + np.repeat(slices.first - own[np.cumsum(counts) - counts], counts)
            texts_at = np.cumsum([0, *(len(x.encode()) + 1 for x in part)])
            stops = np.append(0, np.cumsum(counts))[slices.before]
            out += [(x, begins[a:b] - t) for x, a, b, t in zip(found, stops[:-1].tolist(), stops[1:].tolist(), texts_at[:-1].tolist(), strict=True)]
        return out

    def _encoded(self, slices: Slices) -> tuple[list[bytes], np.ndarray]:
        """The ids of each text, and how many each slice has."""
        if len(self.index) > self.most:
            self._clear()
        keys, checks = _keys(slices.data, slices.first, slices.after)
        distinct, place, which = _distinct(keys)
        known = self.index.get
        entry = np.array([known(k, -1) for k in distinct.tolist()], np.int64)
        new = np.flatnonzero(entry < 0)
        if len(new):
            entry[new] = self._add(distinct[new], checks[place[new]], slices, place[new])
        entry = entry[which]
        if np.array_equal(self.checks[entry], checks):
            counts = self.counts[entry]
            ids = _taken(self.pool, self.starts[entry], counts)
        else:
            ids, counts = self._fill(slices, np.arange(len(slices.begin)))
        data, ends = ids.astype("<u4", copy=False).tobytes(), (4 * np.append(0, np.cumsum(counts))[slices.before]).tolist()
        return [data[a:b] for a, b in zip(ends[:-1], ends[1:], strict=True)], counts


def _distinct(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The different keys in order, a place of each, and which of them each key is (any place will do, so the sort need
    not be stable)."""
    order = np.argsort(keys)
    ordered = keys[order]
    begins = np.flatnonzero(np.append(True, ordered[1:] != ordered[:-1])[: len(ordered)])
    which = np.empty(len(keys), np.int64)
    which[order] = np.repeat(np.arange(len(begins)), np.diff(np.append(begins, len(keys))))
    return ordered[begins], order[begins], which


def _taken(pool: np.ndarray, starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Stretches of a pool, one after the other."""
    before = np.cumsum(counts) - counts
    return pool[np.repeat(starts - before, counts) + np.arange(counts.sum())]


def _rounds(texts: list[str]) -> Iterator[list[str]]:
    part, size = [], 0
    for text in texts:
        if part and size + len(text) > CHUNK:
            yield part
            part, size = [], 0
        part.append(text)
        size += len(text) + 1
    if part:
        yield part


class RankEncoder(Encoder):
    """Pair merging by the ranks of a .tiktoken file. Its dictionaries of ranks leave room for a smaller cache."""

    most = 350_000

    def __init__(self, path: str) -> None:
        super().__init__()
        with open(path, "rb") as lines:
            self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        self.tokens = {v: k for k, v in self.ranks.items()}

    def _fill(self, slices: Slices, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        ids = [self.merged(slices.data[a:b]) for a, b in zip(slices.first[which].tolist(), slices.after[which].tolist(), strict=True)]
        return np.fromiter(chain.from_iterable(ids), np.uint32), np.fromiter(map(len, ids), np.int64, len(ids))

    @functools.cached_property
    def id_widths(self) -> np.ndarray:
        return np.diff(self._bytes[1])

    def merged(self, piece: bytes) -> list[int]:
        """Merges the adjacent pair of lowest rank, the leftmost first, until no pair has a rank."""
        rank = self.ranks.get(piece)
        if rank is not None:
            return [rank]
        if len(piece) > 100:
            return self._merged_long(piece)
        get = self.ranks.get
        parts = [piece[i : i + 1] for i in range(len(piece))]
        pairs = [get(parts[i] + parts[i + 1], 1 << 40) for i in range(len(parts) - 1)]
        while pairs:
            best = min(pairs)
            if best == 1 << 40:
                break
            i = pairs.index(best)
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
            del pairs[i]
            if i:
                pairs[i - 1] = get(parts[i - 1] + parts[i], 1 << 40)
            if i < len(pairs):
                pairs[i] = get(parts[i] + parts[i + 1], 1 << 40)
        return [self.ranks[p] for p in parts]

    def _merged_long(self, piece: bytes) -> list[int]:
        """The same by a heap over a linked list, for slices of any length."""
        n, get = len(piece), self.ranks.get
        end, left, right = list(range(1, n + 1)), list(range(-1, n - 1)), list(range(1, n + 1))
        heap = [(r, i, i + 2) for i in range(n - 1) if (r := get(piece[i : i + 2])) is not None]
        heapq.heapify(heap)
        alive = [True] * n
        while heap:
            _, i, stop = heapq.heappop(heap)
            j = right[i] if alive[i] else n
            if not alive[i] or j >= n or end[j] != stop:
                continue
            end[i], right[i], alive[j] = stop, right[j], False
            if right[i] < n:
                left[right[i]] = i
                if (r := get(piece[i : end[right[i]]])) is not None:
                    heapq.heappush(heap, (r, i, end[right[i]]))
            if left[i] >= 0 and (r := get(piece[left[i] : stop])) is not None:
                heapq.heappush(heap, (r, left[i], stop))
        return [self.ranks[piece[i : end[i]]] for i in range(n) if alive[i]]

    @functools.cached_property
    def _bytes(self) -> tuple[np.ndarray, np.ndarray]:
        size = max(self.tokens) + 1
        lengths = np.array([len(self.tokens.get(i, b"")) for i in range(size)], np.int64)
        return np.frombuffer(b"".join(self.tokens.get(i, b"") for i in range(size)), np.uint8), np.append(0, np.cumsum(lengths))

    def decode(self, ids: np.ndarray) -> tuple[bytes, np.ndarray]:
        """The bytes of the ids, and the byte offset of each id with the total at the end."""
        pool, place = self._bytes
        lengths = place[ids + 1] - place[ids]
        offsets = np.append(0, np.cumsum(lengths))
        where = np.repeat(place[ids] - offsets[:-1], lengths) + np.arange(offsets[-1])
        return pool[where].tobytes(), offsets


def _byte_letters() -> dict[str, int]:
    """The byte that each letter of a byte-level vocabulary stands for: printable ones are themselves,
    the others follow from 256 on."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(rest)}


class LibraryEncoder(Encoder):
    """Merging by a byte-level BPE file of the tokenizers library, which gets each distinct slice.

    Slices of one space and letters are given to it strung together: its own pre-tokeniser cuts such
    a string at the spaces, and ids are told apart again by the byte lengths of their tokens.
    """

    strung = 512

    def __init__(self, path: str) -> None:
        super().__init__()
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # a task has one core
        from tokenizers import Tokenizer

        self.model = Tokenizer.from_file(path)
        self.model.encode_special_tokens = True
        vocab = self.model.get_vocab(with_added_tokens=True)
        self.size = max(vocab.values()) + 1
        self.widths = np.zeros(self.size, np.int64)
        for token, i in vocab.items():
            self.widths[i] = len(token)
        self.added = {t.content: i for i, t in self.model.get_added_tokens_decoder().items()}
        if any(t.single_word or t.lstrip or t.rstrip for t in self.model.get_added_tokens_decoder().values()):
            raise ValueError("added tokens that take what is around them are not supported")
        self.tokens = [b""] * self.size
        letters = _byte_letters()
        for token, i in vocab.items():
            self.tokens[i] = bytes(map(letters.__getitem__, token))

    @functools.cached_property
    def _cuts(self) -> re.Pattern[str]:
        """Added tokens, the longest first where several begin at one place."""
        return re.compile("(" + "|".join(map(re.escape, sorted(self.added, key=len, reverse=True))) + ")")

    def encode_added(self, texts: list[str]) -> list[bytes]:
        """As ``encode``, but added tokens within a text get their own ids, as by the library's plain call."""
        if not self.added or not any(token in text for text in texts for token in self.added):
            return self.encode(texts)
        pieces = list(map(self._cuts.split, texts))  # what is between added tokens, and those at odd places
        ids = iter(self.encode([x for own in pieces for x in own[::2]]))
        own_ids = {t: np.array([i], "<u4").tobytes() for t, i in self.added.items()}
        return [b"".join(own_ids[x] if k % 2 else next(ids) for k, x in enumerate(own)) for own in pieces]

    def text(self, ids: np.ndarray) -> str:
        return b"".join(map(self.tokens.__getitem__, ids.tolist())).decode()

    def _fill(self, slices: Slices, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        words, rest = which[slices.words[which]], which[~slices.words[which]]
        texts, width = slices.texts(words), slices.after - slices.first
        parts = range(0, len(words), self.strung)
        strung = self.model.encode_batch_fast(["".join(texts[k : k + self.strung]) for k in parts], add_special_tokens=False) if texts else []
        ids = np.fromiter(chain.from_iterable(got.ids for got in strung), np.uint32)
        stops = np.searchsorted(np.cumsum(self.widths[ids]), np.cumsum(width[words])) + 1
        single = self.model.encode_batch_fast(slices.texts(rest), add_special_tokens=False) if len(rest) else []
        more = [got.ids for got in single]
        pool = np.concatenate([ids, np.fromiter(chain.from_iterable(more), np.uint32)])
        # Words stand first in the pool, the others after them; both go back to their order.
        counts = np.empty(len(which), np.int64)
        is_word = slices.words[which]
        counts[is_word], counts[~is_word] = np.diff(stops, prepend=0), list(map(len, more))
        starts = np.empty(len(which), np.int64)
        grouped = np.append(np.flatnonzero(is_word), np.flatnonzero(~is_word))
        starts[grouped] = np.cumsum(counts[grouped]) - counts[grouped]
        return _taken(pool, starts, counts), counts


@functools.cache
def rank_encoder(path: str) -> RankEncoder:
    return RankEncoder(path)


@functools.cache
def library_encoder(path: str) -> LibraryEncoder:
    return LibraryEncoder(path)
