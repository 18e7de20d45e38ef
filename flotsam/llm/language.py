"""Language identification with bit-sliced Bloom filters of n-grams."""
from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flotsam.llm.common import slices
from flotsam.llm.grams import bites, char_grams, positions_inside
from flotsam.operators.ranking import top_k
from flotsam.session import materialise

SIZES = (2, 3, 4)               # lengths of the n-grams
SLOTS_LOG2 = 18                 # slots of a filter
SEEDS = (0x9E3779B1, 0xC2B2AE35, 0x27D4EB2F)     # one odd multiplier per hash function
SAMPLE_PER_LANGUAGE = 2000      # rows a language is learned from, at most
SHARE = 0.02                    # an n-gram belongs to a language if so many of its sampled texts hold it


@dataclass
class Filters:
    """``slots[s, w]``: bit l of word w says whether the filter of language 64 * w + l has slot s set."""
    languages: list[str]
    slots: np.ndarray
    wrong: np.ndarray           # chance that an n-gram a language lacks passes its filter
    commonest: int              # language of the most rows, for texts of which no n-gram is known


def _slot(grams: np.ndarray, seed: int) -> np.ndarray:
    return (grams * np.uint32(seed)) >> np.uint32(32 - SLOTS_LOG2)


def fit(docs: DataFrame, learn: Column) -> Filters:
    """Learn from at most ``SAMPLE_PER_LANGUAGE`` rows per language of the rows that ``learn`` admits.

    The sampled rows' n-grams are counted on the cluster, and the filters are filled there as one ``bit_or`` per slot:
    the driver gets at most one word per slot and 64 languages. Rows without a language or text are not used.
    """
    known = docs.where(learn & F.col("lang").isNotNull() & F.col("text").isNotNull())
    thin = known.select("doc_id", "lang", F.xxhash64("doc_id", F.xxhash64("text")).alias("_k"))
    chosen = materialise(top_k(thin, ["lang"], [F.col("_k")], SAMPLE_PER_LANGUAGE, salt_on="_k").select("lang", "_k").distinct())
    names = sorted(r["lang"] for r in chosen.select("lang").distinct().collect())
    if not names:
        return Filters([], np.zeros((1 << SLOTS_LOG2, 1), np.int64), np.zeros(0), 0)
    commonest = thin.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "lang").first()["lang"]
    sample = (known.select("text", "lang", F.xxhash64("doc_id", F.xxhash64("text")).alias("_k")).join(chosen, ["lang", "_k"])
              .withColumn("_l", F.array_position(F.array(*[F.lit(n) for n in names]), F.col("lang")).cast("int") - 1))

    def grams(batches):
        for b in (s for batch in batches for s in slices(batch, "text")):
            lang = b.column("_l").to_numpy(zero_copy_only=False).astype(np.int64)
            found = []
            for rows, points, starts, seen in bites(b.column("text"), max(SIZES) - 1):
                for n in SIZES:
                    h = char_grams(points, n)
                    pos, part = positions_inside(np.arange(len(h)), n, starts, seen)
                    found.append(np.unique((rows[part].astype(np.uint64) << np.uint64(32)) | h[pos]))
            if not found:
                continue
            pairs = np.unique(np.concatenate(found))
            key = (lang[(pairs >> np.uint64(32)).astype(np.int64)].astype(np.uint64) << np.uint64(32)) | (pairs & np.uint64(0xFFFFFFFF))
            key, n = np.unique(key, return_counts=True)
            for i in range(0, len(key), 65536):
                k = key[i:i + 65536]
                yield pa.RecordBatch.from_arrays([pa.array((k >> np.uint64(32)).astype(np.int32)), pa.array((k & np.uint64(0xFFFFFFFF)).astype(np.int64)),
                                                  pa.array(n[i:i + 65536].astype(np.int64))], ["_l", "gram", "n"])

    counts = materialise(sample.select("text", "_l").mapInArrow(grams, "_l int, gram long, n long").groupBy("_l", "gram").agg(F.sum("n").alias("n")))
    sizes = chosen.groupBy("lang").agg(F.count(F.lit(1)).alias("d")).collect()
    need = F.element_at(F.array(*[F.lit(max(1.0, SHARE * next(r["d"] for r in sizes if r["lang"] == n))) for n in names]), F.col("_l") + 1)
    kept = counts.where(F.col("n") >= need)
    low, high = F.col("gram").bitwiseAND(0xFFFF), F.shiftright("gram", 16)         # the product modulo 2**32 without overflow
    hashes = F.array(*[F.shiftright((low * s + F.shiftleft((high * s).bitwiseAND(0xFFFF), 16)).bitwiseAND(0xFFFFFFFF), 32 - SLOTS_LOG2) for s in SEEDS])
    bit = F.expr("shiftleft(1L, _l % 64)")
    words = kept.select(F.explode(hashes).alias("slot"), F.floor(F.col("_l") / 64).alias("w"), bit.alias("bit")).groupBy("slot", "w").agg(F.bit_or("bit").alias("bits"))
    slots = np.zeros((1 << SLOTS_LOG2, -(-len(names) // 64)), np.int64)
    got = words.toArrow()
    slots[got["slot"].to_numpy(), got["w"].to_numpy()] = got["bits"].to_numpy()
    fill = np.array([((slots[:, i // 64] >> (i % 64)) & 1).mean() for i in range(len(names))])
    return Filters(names, slots, fill ** len(SEEDS), names.index(commonest))


def identify(docs: DataFrame, model: Filters, text_col: str = "text") -> Column:
    """Struct ``lang_pred, score`` of a text.

    Every n-gram fetches its slots' words; their AND holds all languages whose filters have it. Per language the hits
    are counted over the whole text and corrected for the chance hits of a filter of that fill. The language with
    most corrected hits wins (ties: first name); the score is its share of all corrected hits. Null text and texts
    without a letter are ``und`` with score 0, as is everything if nothing was learned; a text of which no n-gram is
    known gets the commonest language with score 0. Other columns do not matter.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.arrow_udf("lang_pred string, score double")
    def ask(texts: pa.Array) -> pa.Array:
        m = shared.value
        langs = len(m.languages)
        hits, grams = np.zeros((len(texts), langs)), np.zeros(len(texts))
        for rows, points, starts, seen in bites(texts, max(SIZES) - 1):
            for n in SIZES:
                h = char_grams(points, n)
                pos, part = positions_inside(np.arange(len(h)), n, starts, seen)
                h = h[pos]
                owner = rows[part]
                for w in range(m.slots.shape[1]):
                    mask = m.slots[_slot(h, SEEDS[0]), w]
                    for seed in SEEDS[1:]:
                        mask &= m.slots[_slot(h, seed), w]
                    known = np.flatnonzero(mask)
                    # a word's bits as bytes of 0 and 1, so that one addition per row counts 64 languages
                    bits = np.unpackbits(mask[known].astype("<i8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little", count=min(64, langs - 64 * w))
                    first = np.flatnonzero(np.diff(owner[known], prepend=-1))
                    if len(first):
                        hits[owner[known][first], 64 * w:64 * w + 64] += np.add.reduceat(bits, first, axis=0, dtype=np.int64)
                grams += np.bincount(owner, minlength=len(texts))
        real = np.maximum((hits - grams[:, None] * m.wrong) / np.maximum(1 - m.wrong, 1e-9), 0) if langs else hits
        total = real.sum(1)
        best = np.where(total > 0, real.argmax(1) if langs else 0, m.commonest)
        top = real[np.arange(len(texts)), best] / np.maximum(total, 1e-9) if langs else total
        return pa.StructArray.from_arrays([pa.array([m.languages[i] for i in best] if langs else ["und"] * len(texts), pa.string()), pa.array(top)], ["lang_pred", "score"])

    nothing = F.struct(F.lit("und").alias("lang_pred"), F.lit(0.0).alias("score"))
    has_letter = F.coalesce(F.col(text_col).rlike(r"\p{L}"), F.lit(False))
    return F.when(has_letter, ask(F.coalesce(F.col(text_col), F.lit("")))).otherwise(nothing)
