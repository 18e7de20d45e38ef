"""Byte-level BPE as a streaming transducer with bounded lookahead, and its inverse."""
from __future__ import annotations

import codecs
import hashlib
import heapq
import json
import unicodedata
from collections.abc import Iterable, Iterator
from functools import cache, lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from tokenizers import Regex, pre_tokenizers

from flotsam.llm.common import slices

PIECE = 1 << 17         # code points that the transducer reads at a time
SLICE = 256 << 10       # bytes of text that are taken from an Arrow batch at a time
KNOWN_BYTES = 16 << 20  # memory for the tokens of pre-tokens that a worker remembers
WINDOW = 1 << 12        # bytes beyond the lookahead that are merged at a time inside one long pre-token
# fixed values of the pre-tokenisation: contractions that are cut off, and the white space characters
CONTRACTIONS = ("'s", "'t", "'re", "'ve", "'m", "'ll", "'d")
WHITE_SPACE = [*range(0x09, 0x0E), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
OTHER, LETTER, NUMBER, SPACE = range(4)


@cache
def _classes() -> np.ndarray:
    t = np.zeros(0x110000, np.uint8)
    newer = []
    for p in range(0x110000):
        c = unicodedata.category(chr(p))
        t[p] = LETTER if c[0] == "L" else NUMBER if c[0] == "N" else OTHER
        if c == "Cn" and p < 0x40000:
            newer.append(p)
    # code points younger than Python's tables: as the regular expressions of the tokenizers library see them
    young = "".join(map(chr, newer))
    for kind, pattern in ((LETTER, r"\p{L}"), (NUMBER, r"\p{N}")):
        for c, _ in pre_tokenizers.Split(Regex(pattern), "removed", invert=True).pre_tokenize_str(young):
            t[[ord(x) for x in c]] = kind
    t[WHITE_SPACE] = SPACE
    return t


def _byte_letters() -> dict[str, int]:
    """The letter that stands for each byte in a byte-level vocabulary: itself where it prints, else 256, 257, ..."""
    prints = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(prints)]
    return {chr(b): b for b in prints} | {chr(256 + i): b for i, b in enumerate(rest)}


def sufficient_lookahead(merges: list[tuple[bytes, bytes]]) -> int:
    """Bytes to the right that can still change a token, for this merge list.

    Let two texts share a prefix. While the merges are applied in order, everything left of the first difference stays
    equal; merge k can move the difference to the left only by joining its left part u, which is still common, to a
    token v that begins at the difference in one of the texts, and it moves it by len(u). v then begins with the left
    part of an earlier such merge, so the moves form a chain of ever later merges whose left parts lie on the left
    spines of their successors' right parts. The longest chain bounds the whole movement.
    """
    first: dict[bytes, bytes] = {}      # a token's left part
    reach: dict[bytes, int] = {}        # longest chain so far that ends with this left part
    longest = 0
    for u, v in merges:
        t, before = v, 0
        while t is not None:
            before = max(before, reach.get(t, 0))
            t = first.get(t)
        reach[u] = max(reach.get(u, 0), len(u) + before)
        longest = max(longest, reach[u])
        first.setdefault(u + v, u)
    return longest


class ByteTable:
    """Bytes of every token of a byte-level BPE file: all that decoding needs."""

    def __init__(self, spec: dict):
        letters = _byte_letters()
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.bytes_of: dict[int, bytes] = {i: bytes(letters[c] for c in t) for t, i in spec["model"]["vocab"].items()}
        self.bytes_of |= {i: t.encode() for t, i in self.special.items()}
        # an id that the vocabulary lacks is one byte that begins no character
        parts = [self.bytes_of.get(i, b"\xff") for i in range(max(self.bytes_of) + 2)]
        self.size = np.fromiter(map(len, parts), np.int64, len(parts))
        self.flat, self.begin = np.frombuffer(b"".join(parts), np.uint8), np.cumsum(self.size) - self.size

    def join(self, ids: np.ndarray) -> bytes:
        part = np.minimum(ids, len(self.size) - 1)
        n = self.size[part]
        end = np.cumsum(n)
        return self.flat[np.repeat(self.begin[part] - end + n, n) + np.arange(end[-1])].tobytes() if len(ids) else b""


class Tokenizer(ByteTable):
    """Merge list, vocabulary and special tokens of a byte-level BPE file."""

    def __init__(self, text: str):
        spec = json.loads(text)
        super().__init__(spec)
        pre, model = spec["pre_tokenizer"], spec["model"]
        if (model["type"] != "BPE" or pre["type"] != "ByteLevel" or pre["add_prefix_space"] or not pre["use_regex"] or spec["normalizer"]
                or model["continuing_subword_prefix"] or model["end_of_word_suffix"] or model["byte_fallback"] or model["ignore_merges"]):
            raise ValueError("only plain byte-level BPE is supported")
        letters = _byte_letters()
        raw = lambda t: bytes(letters[c] for c in t)
        vocab = model["vocab"]
        pairs = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
        self.lookahead = sufficient_lookahead([(raw(a), raw(b)) for a, b in pairs])
        self.byte_id = [vocab[c] for c, _ in sorted(letters.items(), key=lambda x: x[1])]
        self.rank = {(vocab[a] << 32) | vocab[b]: r for r, (a, b) in enumerate(pairs)}
        self.joined = [vocab[a + b] for a, b in pairs]
        self.known: dict[bytes, list[int]] = {}
        self.known_bytes = 0
        self._index_pairs()

    def _index_pairs(self) -> None:
        """Open addressing over the pairs, for looking up whole arrays of them."""
        self.slot_pair, self.slot_rank = np.full(1 << 20, -1, np.int64), np.full(1 << 20, len(self.joined), np.int32)
        for pair, r in self.rank.items():
            i = (pair * 0x9E3779B97F4A7C15 % 2 ** 64) >> 44
            while self.slot_pair[i] >= 0:
                i = (i + 1) % (1 << 20)
            self.slot_pair[i], self.slot_rank[i] = pair, r
        self.joined_array = np.array(self.joined, np.int64)
        self.byte_array = np.array(self.byte_id, np.int64)

    def ranks_of(self, pairs: np.ndarray) -> np.ndarray:
        i = ((pairs.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(44)).astype(np.int64)
        there = self.slot_pair[i]
        out = self.slot_rank[i]
        again = np.flatnonzero((there != pairs) & (there >= 0))
        out[again] = len(self.joined)
        while len(again):
            i[again] = (i[again] + 1) & ((1 << 20) - 1)
            there = self.slot_pair[i[again]]
            out[again[there == pairs[again]]] = self.slot_rank[i[again[there == pairs[again]]]]
            again = again[(there != pairs[again]) & (there >= 0)]
        return out

    def merge_many(self, words: list[bytes]) -> list[list[int]]:
        """Tokens of many short pre-tokens at once: every round makes each word's earliest merge, from the left."""
        never = len(self.joined)
        ids = self.byte_array[np.frombuffer(b"".join(words), np.uint8)]
        owner = np.repeat(np.arange(len(words)), np.fromiter(map(len, words), np.int64, len(words)))
        done_ids, done_owner = [], []
        while len(ids):
            first = np.flatnonzero(np.diff(owner, prepend=-1))
            rank = np.full(len(ids), never, np.int32)
            rank[:-1] = self.ranks_of((ids[:-1] << 32) | ids[1:])
            rank[first[1:] - 1] = never
            size = np.diff(first, append=len(ids))
            low = np.repeat(np.minimum.reduceat(rank, first), size)
            over = low == never
            if over.any():
                done_ids.append(ids[over])
                done_owner.append(owner[over])
                ids, owner, rank, low = ids[~over], owner[~over], rank[~over], low[~over]
            at = np.flatnonzero(rank == low)
            if not len(at):
                break
            # of a chain of overlapping equal pairs every second one is merged
            chain = np.flatnonzero(np.diff(at, prepend=-2) != 1)
            at = at[(np.arange(len(at)) - np.repeat(chain, np.diff(chain, append=len(at)))) % 2 == 0]
            ids[at] = self.joined_array[rank[at]]
            keep = np.ones(len(ids), bool)
            keep[at + 1] = False
            ids, owner = ids[keep], owner[keep]
        ids, owner = np.concatenate(done_ids), np.concatenate(done_owner)
        order = np.argsort(owner, kind="stable")
        cut = np.searchsorted(owner[order], np.arange(len(words) + 1)).tolist()
        flat = ids[order].tolist()
        return [flat[a:b] for a, b in zip(cut, cut[1:])]

    # merging

    def _merge_long(self, ids: list[int]) -> list[int]:
        """Tokens of the bytes by a heap over a linked list: for windows of a long pre-token."""
        n, rank = len(ids), self.rank
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(r, i, ids[i], ids[i + 1]) for i in range(n - 1) if (r := rank.get((ids[i] << 32) | ids[i + 1])) is not None]
        heapq.heapify(heap)
        while heap:
            r, i, a, b = heapq.heappop(heap)
            j = after[i]
            if ids[i] != a or j >= n or ids[j] != b:
                continue
            ids[i], ids[j] = self.joined[r], -1
            after[i] = k = after[j]
            if k < n:
                before[k] = i
                if (q := rank.get((ids[i] << 32) | ids[k])) is not None:
                    heapq.heappush(heap, (q, i, ids[i], ids[k]))
            h = before[i]
            if h >= 0 and (q := rank.get((ids[h] << 32) | ids[i])) is not None:
                heapq.heappush(heap, (q, h, ids[h], ids[i]))
        return [t for t in ids if t >= 0]

    def stable(self, pending: bytes) -> tuple[list[int], bytes]:
        """Tokens of the front of an unfinished pre-token that no continuation changes, and the bytes after them."""
        ids, at, out = self._merge_long([self.byte_id[b] for b in pending]), 0, []
        for t in ids:
            if at + len(self.bytes_of[t]) > len(pending) - self.lookahead:
                break
            out.append(t)
            at += len(self.bytes_of[t])
        return out, pending[at:]

    def _remember(self, word: bytes, tokens: list[int]) -> None:
        self.known_bytes += 160 + len(word) + 36 * len(tokens)
        if self.known_bytes > KNOWN_BYTES:
            self.known.clear()
            self.known_bytes = 0
        self.known[word] = tokens

    def words(self, unique: list[bytes]) -> list[list[int]]:
        """Tokens of different whole pre-tokens.

        One no longer than the lookahead has no token that is stable before it ends: all such are merged together, but
        for those remembered. Of a longer one the stable tokens go out window by window.
        """
        get = self.known.get
        found = [get(w) for w in unique]
        new = [i for i, f in enumerate(found) if f is None and len(unique[i]) <= self.lookahead]
        if new:
            fresh = [unique[i] for i in new]
            for i, w, f in zip(new, fresh, self.merge_many(fresh)):
                found[i] = f
                self._remember(w, f)
        return [f if f is not None else self.word(w) for f, w in zip(found, unique)]

    def word(self, w: bytes) -> list[int]:
        """Tokens of one whole pre-token, window by window."""
        out, at = [], 0
        step = self.lookahead + WINDOW
        while at + step < len(w):
            tokens, left = self.stable(w[at:at + step])
            if not tokens:
                step *= 2
                continue
            out += tokens
            at += min(step, len(w) - at) - len(left)
            step = self.lookahead + WINDOW
        return out + self._merge_long([self.byte_id[b] for b in w[at:]])


@lru_cache(2)
def tokenizer(text: str) -> Tokenizer:
    return Tokenizer(text)


@lru_cache(2)
def byte_table(text: str) -> ByteTable:
    return ByteTable(json.loads(text))


def pretoken_starts(points: np.ndarray, cls: np.ndarray, seg: np.ndarray) -> np.ndarray:
    """Marks where pre-tokens begin; ``seg`` holds the starts of the texts that ``points`` joins.

    Runs of one class form a pre-token. The last white space before something else is cut off its run, and a blank
    there goes to what follows. An apostrophe that begins a pre-token takes a contraction's letters with it.
    """
    n = len(points)
    first = np.zeros(n + 1, bool)
    first[seg] = True
    begin = first[:n].copy()
    begin[1:] |= cls[1:] != cls[:-1]
    white = cls == SPACE
    last = np.flatnonzero(white[:-1] & ~white[1:] & ~first[1:n]) if n else np.zeros(0, np.int64)
    begin[last] = True
    blank = last[points[last] == 0x20]
    begin[blank + 1] = False
    mark = np.flatnonzero((points == 0x27) & begin & (cls == OTHER))
    for c in CONTRACTIONS:
        k = len(c)
        at = mark[mark + k <= n]
        for j in range(1, k):
            at = at[(points[at + j] == ord(c[j])) & ~first[at + j]]
        # the run of marks must be the apostrophe alone, so its letters form a run of their own behind it
        begin[at + 1] = False
        at = at[at + k < n]
        begin[at + k] = True
    return begin


_EVEN = np.cumprod(np.concatenate([[np.uint64(1)], np.full(63, 0x9E3779B97F4A7C15, np.uint64)]))
_ODD = np.cumprod(np.concatenate([[np.uint64(1)], np.full(63, 0xC2B2AE3D27D4EB4F, np.uint64)]))


def encode_joined(tok: Tokenizer, texts: list[str], left: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Tokens of whole texts, one after the other, and where each text's tokens begin (one more at the end).

    Equal pre-tokens of the batch are found by two 64-bit hashes and merged once. The last ``left`` code points, which
    begin with a pre-token, are only looked at and not encoded.
    """
    joined = "".join(texts)
    lengths = np.fromiter(map(len, texts), np.int64, len(texts))
    edge = np.concatenate([[0], np.cumsum(lengths)])
    if not joined:
        return np.zeros(0, np.uint32), np.zeros(len(texts) + 1, np.int64)
    points = np.frombuffer(joined.encode("utf-32-le"), "<u4")
    cls = _classes()[points]
    starts = np.flatnonzero(pretoken_starts(points, cls, edge[:-1][lengths > 0]))
    if left:
        points = points[:len(points) - left]
        starts, edge = starts[starts < len(points)], np.minimum(edge, len(points))
    if not len(points):
        return np.zeros(0, np.uint32), np.zeros(len(texts) + 1, np.int64)
    size = np.diff(starts, append=len(points))
    data = joined.encode()
    at = np.zeros(len(points) + 1, np.int64)
    np.cumsum(1 + (points >= 0x80) + (points >= 0x800) + (points >= 0x10000), out=at[1:])
    offset = (np.arange(len(points)) - np.repeat(starts, size)) & 63
    wide = points.astype(np.uint64) + np.uint64(1)
    h = np.add.reduceat(wide * _EVEN[offset], starts)
    h ^= size.astype(np.uint64) << np.uint64(40)
    h *= np.uint64(0xFF51AFD7ED558CCD)
    second = np.add.reduceat(wide * _ODD[offset], starts)
    _, index, inverse = np.unique(h, return_index=True, return_inverse=True)
    if len(points) and (size > 64).any() or (second != second[index][inverse]).any():
        # long pre-tokens (offsets repeat) or a collision: look at every pre-token's own bytes
        lo, hi = at[starts], at[starts + size]
        seen: dict[bytes, int] = {}
        words = [data[a:b] for a, b in zip(lo.tolist(), hi.tolist())]
        inverse = np.fromiter((seen.setdefault(w, len(seen)) for w in words), np.int64, len(words))
        unique = list(seen)
    else:
        lo, hi = at[starts[index]].tolist(), at[starts[index] + size[index]].tolist()
        unique = [data[a:b] for a, b in zip(lo, hi)]
    found = tok.words(unique)
    count = np.fromiter(map(len, found), np.int64, len(found))
    flat = np.fromiter((t for f in found for t in f), np.uint32, int(count.sum()))
    origin = np.concatenate([[0], np.cumsum(count)])[:-1]
    per = count[inverse]
    end = np.concatenate([[0], np.cumsum(per)])
    ids = flat[np.repeat(origin[inverse] - end[:-1], per) + np.arange(end[-1])]
    return ids, end[np.searchsorted(starts, edge)]


class Transducer:
    """Text in, stable tokens out. The state is what the last block left open: the rest of its last text, or the class and
    the unmerged bytes of a pre-token so long that its tokens go out before it ends."""

    def __init__(self, tok: Tokenizer):
        self.tok, self.held, self.inside, self.pending = tok, "", None, b""

    def push(self, parts: list[str], more: bool) -> list[np.ndarray]:
        """Tokens of every part. Parts are texts of their own, but for the first, which goes on where the last block
        ended, and the last, which goes on in the next block if ``more``."""
        first, goes_on = self.held + parts[0], more and len(parts) == 1
        self.held = ""
        front = []
        if self.inside is not None:
            first, front = self._through(first, goes_on)
            if self.inside is not None:
                self.held, first = first, ""
        whole = [first, *parts[1:]]
        left, tail = self._open(whole[-1]) if more else (0, [])
        ids, begin = encode_joined(self.tok, whole, left)
        out = [ids[a:b] for a, b in zip(begin, begin[1:])]
        out[0] = np.concatenate([*front, out[0]])
        out[-1] = np.concatenate([out[-1], *tail])
        return out

    def _open(self, text: str) -> tuple[int, list[np.ndarray]]:
        """Code points at the end of an unfinished text that are not whole pre-tokens, and stable tokens of them if they are many."""
        if not text:
            return 0, []
        points = np.frombuffer(text.encode("utf-32-le"), "<u4")
        cls = _classes()[points]
        starts = np.flatnonzero(pretoken_starts(points, cls, np.zeros(1, np.int64)))
        # three code points back, so that a contraction is seen whole
        cut = int(starts[np.searchsorted(starts, max(len(points) - 3, 0), "right") - 1])
        rest = len(points) - cut
        if rest < PIECE:
            self.held = text[cut:]
            return rest, []
        blank_first = points[cut] == 0x20 and cls[cut + 1] != SPACE
        self.inside = int(cls[cut + 1]) if blank_first else int(cls[cut])
        self.pending = b" " if blank_first else b""
        self.held, out = self._through(text[cut + blank_first:], True)
        return rest, out

    def _through(self, text: str, goes_on: bool) -> tuple[str, list[np.ndarray]]:
        """Reads on inside the long pre-token: the text not read, and its tokens that are stable or, at its end, all."""
        cls = _classes()[np.frombuffer(text.encode("utf-32-le"), "<u4")]
        stop = np.flatnonzero(cls != self.inside)
        ends = len(stop) > 0 or not goes_on
        run = int(stop[0]) if len(stop) else len(cls)
        if self.inside == SPACE and (len(stop) or goes_on):
            run = max(run - 1, 0)               # the last white space may belong to what follows
        self.pending += text[:run].encode()
        if ends:
            out = [np.array(self.tok.word(self.pending), np.uint32)]
            self.inside, self.pending = None, b""
            return text[run:], out
        out, step = [], self.tok.lookahead + WINDOW
        while len(self.pending) > step:
            tokens, left = self.tok.stable(self.pending[:step])
            if not tokens:
                step *= 2
                continue
            self.pending = left + self.pending[step:]
            step = self.tok.lookahead + WINDOW
            out.append(np.array(tokens, np.uint32))
        return text[run:], out


def encode_stream(tok: Tokenizer, pieces: Iterable[str]) -> Iterator[np.ndarray]:
    """Tokens of one text that comes in pieces; holds one piece, or lookahead and window inside a long pre-token."""
    machine = Transducer(tok)
    for piece in pieces:
        yield machine.push([piece], True)[0]
    yield machine.push([""], False)[0]


def _segments(tok: Tokenizer, text: str) -> list[str | int]:
    """A text cut at its special tokens, which are given by their ids."""
    parts: list[str | int] = [text]
    for s, i in tok.special.items():
        if s in text:
            parts = [q for p in parts for q in (_around(p, s, i) if isinstance(p, str) else [p])]
    return parts


def _around(p: str, s: str, i: int) -> list[str | int]:
    out: list[str | int] = []
    for k, q in enumerate(p.split(s)):
        out += [i, q] if k else [q]
    return out


def transduce(tok: Tokenizer, texts: Iterable[str]) -> Iterator[tuple[int, np.ndarray]]:
    """``(number of the text, tokens)`` in the order of the texts; a long text's tokens come in several parts.

    One machine reads all texts, in blocks of about ``PIECE`` code points: several short texts, or a piece of a long one.
    """
    machine = Transducer(tok)
    block: list[tuple[int, str | int]] = []
    held = 0

    def flush(more: bool) -> Iterator[tuple[int, np.ndarray]]:
        parts = [p for _, p in block if isinstance(p, str)]
        ids = iter(machine.push(parts, more) if parts else [])
        for i, p in block:
            yield i, next(ids) if isinstance(p, str) else np.array([p], np.uint32)
        block.clear()

    for i, text in enumerate(texts):
        for segment in _segments(tok, text):
            if isinstance(segment, int):
                block.append((i, segment))
                continue
            at = 0
            while held + len(segment) - at > PIECE:
                end = at + PIECE - held
                block.append((i, segment[at:end]))
                yield from flush(True)
                at, held = end, 0
            block.append((i, segment[at:]))
            held += len(segment) - at
    yield from flush(False)


def encode_texts(tok: Tokenizer, texts: list[str]) -> list[np.ndarray]:
    """Token ids of whole texts."""
    out: list[list[np.ndarray]] = [[np.zeros(0, np.uint32)] for _ in texts]
    for i, ids in transduce(tok, texts):
        out[i].append(ids)
    return [np.concatenate(x) for x in out]


class Decoder:
    """Tokens in, text out. The state is the unfinished character at the end of what was read.

    Bytes that form no character become U+FFFD, as does an id that the vocabulary lacks.
    """

    def __init__(self, table: ByteTable):
        self.table, self.machine = table, codecs.getincrementaldecoder("utf-8")("replace")

    def push(self, ids: np.ndarray) -> str:
        return self.machine.decode(self.table.join(ids))

    def end(self) -> str:
        return self.machine.decode(b"", final=True)


def decode_pieces(table: ByteTable, ids: np.ndarray, step: int = 1 << 16) -> Iterator[str]:
    """Text of the tokens, piece by piece."""
    machine = Decoder(table)
    for i in range(0, len(ids), step):
        yield machine.push(ids[i:i + step])
    yield machine.end()


# frames

class _Row:
    """What is known of one text while its tokens come in; with ``whole`` its tokens and decoded text, else their digests."""

    def __init__(self, table: ByteTable, whole: bool):
        self.n, self.decoder, self.whole = 0, Decoder(table), whole
        self.ids, self.text = ([], []) if whole else (hashlib.sha256(), hashlib.sha256())

    def push(self, ids: np.ndarray) -> None:
        self.n += len(ids)
        self._text(self.decoder.push(ids))
        data = ids.astype("<u4").tobytes()
        self.ids.append(data) if self.whole else self.ids.update(data)

    def _text(self, text: str) -> None:
        self.text.append(text) if self.whole else self.text.update(text.encode())

    def end(self) -> tuple:
        self._text(self.decoder.end())
        return (self.n, b"".join(self.ids), "".join(self.text)) if self.whole else (self.n, self.ids.hexdigest(), self.text.hexdigest())


def _round_trips(tok: Tokenizer, texts: list[str], whole: bool) -> Iterator[tuple]:
    at, row = 0, _Row(tok, whole)
    for i, ids in transduce(tok, texts):
        while at < i:
            yield row.end()
            at, row = at + 1, _Row(tok, whole)
        row.push(ids)
    while at < len(texts):
        yield row.end()
        at, row = at + 1, _Row(tok, whole)


def _frame(docs: DataFrame, tokenizer_json: str, id_col: str, text_col: str, whole: bool, names: tuple[str, str], kinds: tuple[str, str]) -> DataFrame:
    shared = docs.sparkSession.sparkContext.broadcast(tokenizer_json)
    second, third = (pa.binary(), pa.string()) if whole else (pa.string(), pa.string())

    def run(batches):
        tok = tokenizer(shared.value)
        for batch in batches:
            for b in slices(batch, text_col, SLICE):
                n, x, y = zip(*_round_trips(tok, [t or "" for t in b.column(text_col).to_pylist()], whole))
                yield pa.RecordBatch.from_arrays([b.column(id_col), pa.array(n, pa.int64()), pa.array(x, second), pa.array(y, third)], ["doc_id", "n_tokens", *names])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, text_col).mapInArrow(run, f"doc_id {kind}, n_tokens long, {names[0]} {kinds[0]}, {names[1]} {kinds[1]}")


def round_trip(docs: DataFrame, tokenizer_json: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, n_tokens, ids, decoded``: tokens of every whole text (little-endian unsigned 32-bit integers), and the text
    that the decoder makes of them; encoded and decoded in one pass.

    ``tokenizer_json`` is the content of a byte-level BPE file. Null text counts as empty and has no tokens; very long
    texts are read in pieces; repeated rows give repeated rows; no rows give none. Other columns are ignored.
    """
    return _frame(docs, tokenizer_json, id_col, text_col, True, ("ids", "decoded"), ("binary", "string"))


def digests(docs: DataFrame, tokenizer_json: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, n_tokens, ids_sha256, decoded_sha256``: as ``round_trip``, but tokens and decoded text go into their digests
    as they come and are never held whole."""
    return _frame(docs, tokenizer_json, id_col, text_col, False, ("ids_sha256", "decoded_sha256"), ("string", "string"))


def encode(docs: DataFrame, tokenizer_json: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, n_tokens, ids`` of every whole text, as in ``round_trip``."""
    return round_trip(docs, tokenizer_json, id_col, text_col).drop("decoded")


def decode(tokens: DataFrame, tokenizer_json: str, ids_col: str = "ids") -> Column:
    """Text of a column of little-endian unsigned 32-bit ids; null gives an empty text."""
    shared = tokens.sparkSession.sparkContext.broadcast(tokenizer_json)

    @F.arrow_udf("string")
    def text(ids: pa.Array) -> pa.Array:
        table = byte_table(shared.value)
        return pa.array(["".join(decode_pieces(table, np.frombuffer(x.as_py() or b"", "<u4"))) for x in ids], pa.string())

    return text(F.col(ids_col))
