"""Spelling variants: words one edit apart, found by blocked Gram matrices of letter counts."""
from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flotsam.llm.common import slices, spread
from flotsam.session import materialise, release

SHORTEST = 6            # code points of a word
RARE = 5                # a word occurs at least so often
RATIO = 5               # a form occurs at least so many times as often as its variant
DAMAGE = 199            # a run is damaged when this divides its checksum
PIECE = 1 << 20         # code points of a text that are read at a time
HELD = 1 << 17          # words that a task counts before it sends them on
CHUNK = 1 << 14         # code points of a block's chunk: one side of a matrix product
COLUMNS = 26 + 64       # letters: a-z and U+00C0 to U+00FF
GROUPS = 5              # groups of letters whose counts, together, name a block

_LETTERS = [*range(ord("a"), ord("z") + 1), *range(0xC0, 0x100)]
# every byte of a Latin-1 text: letters stay, A-Z become a-z, everything else a blank
_FOLD = bytes(b + 32 if 0x41 <= b <= 0x5A else b if b in set(_LETTERS) else 0x20 for b in range(256))
_COLUMN = np.zeros(256, np.int64)
_COLUMN[_LETTERS] = np.arange(COLUMNS)


def pieces(text: str, size: int) -> Iterator[str]:
    """A long text in pieces that end before a character that belongs to no word."""
    at = 0
    while at < len(text):
        end = min(at + size, len(text))
        while end < len(text) and ord(text[end]) < 256 and _FOLD[ord(text[end])] != 0x20:
            end += 1
        yield text[at:end]
        at = end


def damaged(word: bytes, h: int) -> bytes:
    """The run without the code point that its checksum names, if the checksum says so."""
    if h % DAMAGE:
        return word
    k = h % len(word)
    return word[:k] + word[k + 1:]


def _counter(shortest: int):
    runs = re.compile(rb"[a-z\xc0-\xff]{%d,}" % shortest).findall

    def flush(held: Counter) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([w.decode("latin-1") for w in held], pa.string()), pa.array(list(held.values()), pa.int64())], ["word", "n"])

    def run(batches):
        held: Counter = Counter()
        for batch in batches:
            for b in slices(batch, "text"):
                for i, text in zip(b.column("id").to_pylist(), b.column("text")):
                    start = zlib.crc32(f"{i}:".encode())
                    for piece in pieces(text.as_py(), PIECE):
                        for w, n in Counter(runs(piece.encode("latin-1", "replace").translate(_FOLD))).items():
                            got = damaged(w, zlib.crc32(w if w.isascii() else w.decode("latin-1").encode(), start))
                            if len(got) >= shortest:
                                held[got] += n
                        if len(held) > HELD:
                            yield flush(held)
                            held.clear()
        if held:
            yield flush(held)
    return run


def count_words(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shortest: int = SHORTEST, rare: int = RARE) -> DataFrame:
    """``word, n`` of the words of all texts, after the damage, that are long and frequent enough.

    Words are maximal runs of A-Z, a-z and U+00C0 to U+00FF, with A-Z lower-cased. Tasks count before they send, so a
    frequent word travels once per task and flush, not once per occurrence.
    """
    thin = docs.where(F.col(text_col).isNotNull()).select(F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("id"), F.col(text_col).alias("text"))
    return thin.mapInArrow(_counter(shortest), "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= rare)


# blocks

def _group_counts(word: Column) -> Column:
    """Letters of the word per group: a letter's group is its code point modulo ``GROUPS``."""
    return F.array(*[F.length(F.regexp_replace(word, "[^" + "".join(chr(c) for c in _LETTERS if c % GROUPS == g) + "]", "")) for g in range(GROUPS)])


def _partners(block: Column) -> Column:
    """Blocks that may hold a word one edit away, each pair of blocks from one side only.

    A replaced letter leaves the counts or moves one from a group to another (the same length); an inserted letter
    adds one to a group (the next length).
    """
    def moved(up: int | None, down: int | None) -> Column:
        return F.array(*[block[g] + (1 if g == up else 0) - (1 if g == down else 0) for g in range(GROUPS)])

    same = [moved(i, j) for i in range(GROUPS) for j in range(i + 1, GROUPS)]
    return F.array(block, *same, *[moved(g, None) for g in range(GROUPS)])


def _codes(words: pa.Array, length: int) -> np.ndarray:
    return np.frombuffer("".join(words.to_pylist()).encode("latin-1"), np.uint8).reshape(len(words), length)


def _letter_counts(codes: np.ndarray) -> np.ndarray:
    m, length = codes.shape
    at = (np.arange(m)[:, None] * COLUMNS + _COLUMN[codes]).ravel()
    return np.bincount(at, minlength=m * COLUMNS).reshape(m, COLUMNS).astype(np.float32)


def _near(a: np.ndarray, b: np.ndarray, same: bool, step: int = 1 << 16) -> tuple[np.ndarray, np.ndarray]:
    """Places of the pairs of words (rows of code points) exactly one edit apart; ``b`` is as long as ``a`` or one longer.

    |x - y|² = |x|² + |y|² - 2 xy of the letter counts is 2 for a replaced letter and 1 for an inserted one (0: the
    same letters in another order, never one edit). What the product leaves is verified on the words.
    """
    length, grown = a.shape[1], b.shape[1] > a.shape[1]
    x, y = _letter_counts(a), _letter_counts(b)
    square = (x * x).sum(1)[:, None] + (y * y).sum(1)[None, :] - 2 * (x @ y.T)
    close = square == (1 if grown else 2)
    if same:
        close = np.triu(close, 1)
    i, j = np.nonzero(close)
    ok = np.zeros(len(i), bool)
    step = max(1, step // length)
    for k in range(0, len(i), step):
        p, q = a[i[k:k + step]], b[j[k:k + step]]
        if not grown:
            ok[k:k + step] = (p != q).sum(1) == 1
            continue
        front, back = p != q[:, :-1], p != q[:, 1:]
        first = np.where(front.any(1), front.argmax(1), length)             # equal before this place
        last = np.where(back.any(1), length - 1 - back[:, ::-1].argmax(1), -1)     # equal, moved by one, behind this one
        ok[k:k + step] = last < first
    return i[ok], j[ok]


def _tally(word: pa.Array, n: np.ndarray, me: np.ndarray, other: pa.Array, other_n: np.ndarray, it: np.ndarray) -> list[pa.Array]:
    """Per word of one side: how many near words the other side holds and the best of them (both sides sorted by word)."""
    order = np.lexsort((it, -other_n[it], me))
    me, it = me[order], it[order]
    first = np.flatnonzero(np.diff(me, prepend=-1))
    count = np.diff(first, append=len(me))
    return [word.take(pa.array(me[first])), pa.array(count, pa.int64()), pa.array(other_n[it[first]], pa.int64()), other.take(pa.array(it[first]))]


def _products(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["word", "n_near", "best_n", "best"]
    for batch in batches:
        out = []
        for r in range(batch.num_rows):
            a, b = batch.column("a_words")[r].values, batch.column("b_words")[r].values
            an, bn = (batch.column(c)[r].values.to_numpy() for c in ("a_n", "b_n"))
            ca, cb = _codes(a, batch.column("length")[r].as_py()), _codes(b, batch.column("b_length")[r].as_py())
            i, j = _near(ca, cb, batch.column("same")[r].as_py())
            if len(i):
                out += [pa.RecordBatch.from_arrays(_tally(a, an, i, b, bn, j), names), pa.RecordBatch.from_arrays(_tally(b, bn, j, a, an, i), names)]
        yield from out


def near_words(words: DataFrame) -> DataFrame:
    """``word, n_near, best_n, best`` of every word that has others exactly one edit away; ``words``: word, n (materialised).

    Words are dealt to blocks by their letters per group (so by length too), and a large block to chunks of
    ``CHUNK`` code points; every row of the plan is one product of two chunks. A block meets itself, blocks of
    its length with one letter in another group, and blocks one letter longer: no other block can hold a near word,
    so nothing is lost, however many words share a block. A product answers with at most one row per word.
    """
    placed = words.withColumn("block", _group_counts(F.col("word")))
    chunks = F.ceil(F.count(F.lit(1)) * F.first(F.length("word")) / CHUNK).cast("int")
    large = materialise(placed.groupBy("block").agg(chunks.alias("_chunks")).where(F.col("_chunks") > 1))    # at most a row per CHUNK code points
    placed = placed.join(F.broadcast(large), "block", "left")
    chunk = F.pmod(F.xxhash64("word"), F.coalesce("_chunks", F.lit(1))).cast("int")
    listed = F.sort_array(F.collect_list(F.struct("word", "n")))
    dealt = materialise(placed.groupBy("block", chunk.alias("chunk")).agg(listed.alias("_w"))
                        .select("block", "chunk", F.length(F.col("_w")[0]["word"]).alias("length"), F.col("_w.word").alias("words"), F.col("_w.n").alias("n")))
    left = dealt.select("block", "length", F.col("chunk").alias("a_chunk"), F.col("words").alias("a_words"), F.col("n").alias("a_n"), F.explode(_partners(F.col("block"))).alias("b_block"))
    left = left.join(F.broadcast(large.withColumnRenamed("block", "b_block")), "b_block", "left")
    left = left.withColumn("b_chunk", F.explode(F.sequence(F.lit(0), F.coalesce("_chunks", F.lit(1)) - 1)))
    right = dealt.select(F.col("block").alias("b_block"), F.col("length").alias("b_length"), F.col("chunk").alias("b_chunk"), F.col("words").alias("b_words"), F.col("n").alias("b_n"))
    own = F.col("block") == F.col("b_block")
    met = spread(left, "b_block", "b_chunk").join(spread(right, "b_block", "b_chunk"), ["b_block", "b_chunk"]).where(~own | (F.col("a_chunk") <= F.col("b_chunk")))
    rows = met.select("length", "b_length", (own & (F.col("a_chunk") == F.col("b_chunk"))).alias("same"), "a_words", "a_n", "b_words", "b_n")
    found = rows.mapInArrow(_products, "word string, n_near long, best_n long, best string")
    best = F.min(F.struct((-F.col("best_n")).alias("m"), F.col("best").alias("w")))
    return found.groupBy("word").agg(F.sum("n_near").alias("n_near"), best.alias("_b")).select("word", "n_near", (-F.col("_b.m")).alias("best_n"), F.col("_b.w").alias("best"))


def roots(forms: DataFrame, max_rounds: int = 40) -> DataFrame:
    """``word, root``: from every word of ``forms`` (word, form) its forms are followed to the last.

    A form occurs at least ``RATIO`` times as often as its variant, so chains end; every round doubles the step.
    """
    r = materialise(forms.select("word", F.col("form").alias("root")))
    for _ in range(max_rounds):
        step = r.join(r.select(F.col("word").alias("root"), F.col("root").alias("_next")), "root", "left")
        after = materialise(step.select("word", F.coalesce("_next", "root").alias("root"), F.col("_next").isNotNull().alias("_moved")))
        moved = after.where("_moved").limit(1).count()
        release(r)
        r = after.drop("_moved")
        if not moved:
            return r
    raise RuntimeError("forms do not end")


def variants(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shortest: int = SHORTEST, rare: int = RARE, ratio: int = RATIO) -> DataFrame:
    """``word, form, root, n, n_near, form_n`` of every word of the texts; ``docs`` needs an id and a text column.

    Two words are near if exactly one inserted, deleted or replaced code point parts them. A word's form is its near
    word of largest ``n`` (ties: the smallest in code-point order) if that is ``ratio`` times its own or more; its
    root is the last of the forms that follow from it. Before words are counted, runs are damaged: where 199 divides
    h, the crc32 of ``<id>:<run>``, the code point h modulo the length is deleted.

    Null and empty texts hold no words; a null id counts as an empty one. Very long texts are read in pieces.
    Repeated rows are counted again. No rows give no rows; other columns are ignored.
    """
    words = materialise(count_words(docs, id_col, text_col, shortest, rare))
    near = near_words(words)
    has_form = F.col("best_n") >= ratio * F.col("n")
    told = materialise(words.join(near, "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(has_form, F.col("best")).alias("form"), F.when(has_form, F.col("best_n")).alias("form_n")))
    last = roots(told.where(F.col("form").isNotNull()))
    return told.join(last, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
