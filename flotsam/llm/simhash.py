"""SimHash near-duplicates: a binary trie of fingerprints joined with itself under a Hamming budget."""
from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flotsam.llm.common import WHITE, slices, spread
from flotsam.operators.components import connected_components
from flotsam.session import materialise

WORDS = 3               # words of a shingle
BUDGET = 3              # bits in which linked fingerprints may differ
SEED = 42
DEPTH = 5               # bits of the first cut of the trie: 432 pairs of subtrees at a budget of 3
STEP = 4                # bits by which a pair of subtrees that is too large goes down
BLOCK = 1 << 18         # fingerprints of a subtree that one task may hold
FRONT = 1 << 16         # pairs of nodes that are worked on at a time
PIECE = 1 << 20         # bytes of a text that are hashed at a time
HOT_SHARE = 1000        # a fingerprint is hot when more than one in so many rows has it


# fingerprints

def _pieces(text: str, size: int) -> Iterator[str]:
    """A long text in pieces that end at white space."""
    at = 0
    while at < len(text):
        end = min(at + size, len(text))
        while end < len(text) and text[end] not in WHITE:
            end += 1
        yield text[at:end]
        at = end


def shingle_hashes(text: str, words: int = WORDS, piece: int = PIECE) -> Iterator[np.ndarray]:
    """XXH64 of the text's word shingles, repeats included, in arrays of bounded size.

    ``bytes.lower`` changes A-Z alone and ``bytes.split`` splits at exactly the six white space characters.
    """
    held: list[bytes] = []
    some = False
    for part in _pieces(text, piece):
        held += part.encode().lower().split()
        if len(held) < words:
            continue
        some = True
        size = np.fromiter(map(len, held), np.int64, len(held)) + 1
        end = np.cumsum(size) - 1
        start = (end - size + 1)[:len(held) - words + 1].tolist()
        joined = b" ".join(held)
        hashes = [xxhash.xxh64_intdigest(joined[a:b], SEED) for a, b in zip(start, end[words - 1:].tolist())]
        yield np.array(hashes, np.uint64)
        held = held[len(held) - words + 1:]
    if not some and held:
        yield np.array([xxhash.xxh64_intdigest(b" ".join(held), SEED)], np.uint64)


def bit_counts(hashes: np.ndarray, step: int = 1 << 13) -> np.ndarray:
    """How many of the hashes have each bit set, bit 0 first."""
    out = np.zeros(64, np.int64)
    for k in range(0, len(hashes), step):
        part = hashes[k:k + step].astype("<u8")
        out += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return out


def fingerprint(text: str, words: int = WORDS, piece: int = PIECE) -> int:
    """Bits that more than half of the shingle hashes have; zero without a word."""
    n, count = 0, np.zeros(64, np.int64)
    for h in shingle_hashes(text, words, piece):
        n += len(h)
        count += bit_counts(h)
    return int.from_bytes(np.packbits(2 * count > n, bitorder="little").tobytes(), "little") if n else 0


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS) -> DataFrame:
    """``doc_id, fp`` (the 64 bits as a signed long) of every row."""
    def run(batches):
        for batch in batches:
            for b in slices(batch, "_text"):
                fp = np.array([fingerprint(t.as_py(), words) for t in b.column("_text")], np.uint64)
                yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(fp.view(np.int64))], ["doc_id", "fp"])

    thin = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("_text"))
    return thin.mapInArrow(run, "doc_id long, fp long")


# the trie: a node is the range of a sorted array that shares its first bits

def _labels(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Labels of the components after the links (a, b) join them; a label is a component's first place."""
    while True:
        x, y = label[a], label[b]
        open_ = x != y
        if not open_.any():
            return label
        a, b, x, y = a[open_], b[open_], x[open_], y[open_]
        root = np.arange(len(label))
        np.minimum.at(root, np.maximum(x, y), np.minimum(x, y))
        while (root[root] != root).any():
            root = root[root]
        label = root[label]


def join_tries(a: np.ndarray, b: np.ndarray, depth: int, used: int, budget: int = BUDGET, front: int = FRONT) -> tuple[np.ndarray, np.ndarray]:
    """Links that connect what fingerprints at most ``budget`` bits apart connect, between two subtrees or inside one.

    ``a`` and ``b`` are sorted; each holds fingerprints with the same first ``depth`` bits, and these differ in ``used``
    bits between the two (a subtree meets itself when both arrays are equal). Pairs of nodes go down together, one
    bit at a time; a pair of unlike children spends one bit of the budget and is pruned beyond it. Pairs whose nodes
    one component holds already are pruned too: they add nothing to it. The pairs waiting are worked on depth first,
    ``front`` at a time, so memory does not grow with their number. At most one link per fingerprint is returned.
    """
    inside = len(a) == len(b) and bool((a == b).all())
    values = a if inside else np.concatenate([a, b])
    base = 0 if inside else len(a)
    label = np.arange(len(values))
    starts = [np.array([x]) for x in (0, len(a), base, base + len(b), used)]
    waiting = [(depth, starts)]
    while waiting:
        level, (al, ah, bl, bh, u) = waiting.pop()
        if len(al) > front:
            waiting += [(level, [x[k:k + front] for x in (al, ah, bl, bh, u)]) for k in range(0, len(al), front)]
            continue
        # prune what is connected as a whole: sums of changes tell whether a range has one label
        change = np.concatenate([[0], np.cumsum(label[1:] != label[:-1])])
        known = (change[ah - 1] == change[al]) & (change[bh - 1] == change[bl]) & (label[al] == label[bl])
        single = (ah - al == 1) & (bh - bl == 1)
        last = single & ~known
        if last.any():
            i, j = al[last], bl[last]
            near = np.bitwise_count(values[i] ^ values[j]) <= budget
            if near.any():
                label = _labels(label, i[near], j[near])
        keep = ~known & ~single
        if level == 64 or not keep.any():
            continue
        al, ah, bl, bh, u = (x[keep] for x in (al, ah, bl, bh, u))
        bit = ((values >> np.uint64(63 - level)) & np.uint64(1)).astype(np.int64)
        ones = np.concatenate([[0], np.cumsum(bit)])
        am, bm = ah - (ones[ah] - ones[al]), bh - (ones[bh] - ones[bl])
        mirror = (al == bl) & inside            # a node with itself: one of the two mixed pairs suffices
        parts = [(al, am, bl, bm, u, None), (am, ah, bm, bh, u, None), (al, am, bm, bh, u + 1, None), (am, ah, bl, bm, u + 1, mirror)]
        below = []
        for pl, ph, ql, qh, v, skip in parts:
            ok = (ph > pl) & (qh > ql) & (v <= budget)
            if skip is not None:
                ok &= ~skip
            below.append([x[ok] for x in (pl, ph, ql, qh, v)])
        together = [np.concatenate(x) for x in zip(*below)]
        if len(together[0]):
            waiting.append((level + 1, together))
    far = np.flatnonzero(label != np.arange(len(values)))
    return values[far], values[label[far]]


def _walk(batches: Iterator[pa.RecordBatch], budget: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for r in range(batch.num_rows):
            depth, used = batch.column("depth")[r].as_py(), batch.column("used")[r].as_py()
            a = np.sort(batch.column("a")[r].values.to_numpy().view(np.uint64))
            b = np.sort(batch.column("b")[r].values.to_numpy().view(np.uint64)) if batch.column("b")[r].is_valid else a
            x, y = join_tries(a, b, depth, used, budget)
            if len(x):
                yield pa.RecordBatch.from_arrays([pa.array(x.view(np.int64)), pa.array(y.view(np.int64))], ["x", "y"])


def _prefix(fp: Column, depth: int) -> Column:
    return F.shiftrightunsigned(fp, 64 - depth)


def _children(pairs: DataFrame, nodes: DataFrame, budget: int) -> DataFrame:
    """Pairs of nodes within the budget, out of pairs of prefixes ``p <= q``; ``nodes``: p, n."""
    other = nodes.select(F.col("p").alias("q"), F.col("n").alias("m"))
    return (pairs.join(nodes, "p").join(other, "q").withColumn("used", F.bit_count(F.col("p").bitwiseXOR(F.col("q"))))
            .where(F.col("used") <= budget).select("p", "q", "n", "m", "used"))


def subtree_pairs(fps: DataFrame, budget: int = BUDGET, depth: int = DEPTH, block: int = BLOCK) -> DataFrame:
    """``depth, p, q, used``: pairs of subtrees of the trie that cover all pairs of fingerprints within the budget.

    The upper part of the traversal, on counts: pairs of prefixes of ``depth`` bits go down ``STEP`` bits together while
    one of the two holds more than ``block`` fingerprints.
    """
    masks = [m for m in range(1 << depth) if bin(m).count("1") <= budget]
    nodes = materialise(fps.groupBy(_prefix(F.col("fp"), depth).alias("p")).agg(F.count(F.lit(1)).alias("n")))
    q = F.explode(F.array(*[F.col("p").bitwiseXOR(F.lit(m).cast("bigint")) for m in masks]))
    live = materialise(_children(nodes.select("p", q.alias("q")).where(F.col("p") <= F.col("q")), nodes, budget))
    done = None
    while True:
        large = (F.greatest("n", "m") > block) if depth + STEP < 64 else F.lit(False)
        settled = live.where(~large).select(F.lit(depth).alias("depth"), "p", "q", "used")
        done = settled if done is None else done.unionByName(settled)
        if not live.where(large).limit(1).count():
            return done
        depth += STEP
        nodes = materialise(fps.groupBy(_prefix(F.col("fp"), depth).alias("p")).agg(F.count(F.lit(1)).alias("n")))
        kids = F.array(*[F.lit(k).cast("bigint") for k in range(1 << STEP)])
        down = (live.where(large).select((F.col("p") * (1 << STEP)).alias("p"), (F.col("q") * (1 << STEP)).alias("q"))
                .withColumn("x", F.explode(kids)).withColumn("y", F.explode(kids)).select((F.col("p") + F.col("x")).alias("p"), (F.col("q") + F.col("y")).alias("q"))
                .where(F.col("p") <= F.col("q")))
        live = materialise(_children(down, nodes, budget))


def links(fps: DataFrame, budget: int = BUDGET, depth: int = DEPTH, block: int = BLOCK) -> DataFrame:
    """``x, y``: links between different fingerprints that connect exactly what all links within the budget connect.

    ``fps``: different fingerprints ``fp`` (materialised). Every pair of subtrees is one row with both sorted lists, at
    most ``block`` fingerprints each, and one traversal.
    """
    pairs = materialise(subtree_pairs(fps, budget, depth, block))
    depths = sorted(r["depth"] for r in pairs.select("depth").distinct().collect())
    if not depths:
        return fps.select(F.col("fp").alias("x"), F.col("fp").alias("y")).limit(0)
    at = F.explode(F.array(*[F.struct(F.lit(d).alias("depth"), _prefix(F.col("fp"), d).alias("p")) for d in depths]))
    used = pairs.select("depth", "p").unionByName(pairs.select("depth", F.col("q").alias("p"))).distinct()
    subtrees = materialise(fps.select("fp", at.alias("at")).select("fp", "at.*").join(used, ["depth", "p"])
                           .groupBy("depth", "p").agg(F.sort_array(F.collect_list("fp")).alias("a")))
    other = subtrees.select("depth", F.col("p").alias("q"), F.col("a").alias("b"))
    two = pairs.where(F.col("p") != F.col("q")).join(subtrees, ["depth", "p"]).join(other, ["depth", "q"]).select("depth", "p", "q", "used", "a", "b")
    one = pairs.where(F.col("p") == F.col("q")).join(subtrees, ["depth", "p"]).select("depth", "p", "q", "used", "a", F.lit(None).cast("array<bigint>").alias("b"))
    return spread(two.unionByName(one), "p", "q").mapInArrow(lambda batches: _walk(batches, budget), "x long, y long")


def near_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS, budget: int = BUDGET,
                depth: int = DEPTH, block: int = BLOCK) -> DataFrame:
    """``doc_id, fingerprint, component_id`` of every row: texts whose fingerprints differ in ``budget`` bits or less are linked.

    ``component_id`` is the smallest id among all documents that links connect, the document itself included. Equal
    fingerprints are one node from the start, so copies are never paired. Null and empty texts have the fingerprint
    zero and are linked like any other; texts of fewer than ``words`` words have one shingle. A null id is kept and
    is a ``component_id`` only where the component has no other. Repeated rows are repeated in the result. Very long
    texts are hashed in pieces. No rows give no rows; other columns are ignored.
    """
    rows = materialise(fingerprints(docs, id_col, text_col, words))
    nodes = materialise(rows.groupBy("fp").agg(F.min("doc_id").alias("least"), F.count(F.lit(1)).alias("n")))
    joined = connected_components(links(nodes.select("fp"), budget, depth, block), "x", "y")
    placed = materialise(nodes.join(joined.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "least", "n", F.coalesce("component", "fp").alias("component")))
    named = placed.groupBy("component").agg(F.min("least").alias("component_id"))
    of_fp = materialise(placed.join(named, "component").select("fp", "n", "component_id"))
    # a fingerprint of very many rows is looked up without a shuffle: there are fewer than HOT_SHARE such
    hot = of_fp.where(F.col("n") * HOT_SHARE > rows.count()).select("fp", F.struct("component_id").alias("_hot"))
    told = rows.join(F.broadcast(hot), "fp", "left")
    rest = told.where(F.col("_hot").isNull()).drop("_hot").join(of_fp.select("fp", "component_id"), "fp")
    every = told.where(F.col("_hot").isNotNull()).select("fp", "doc_id", F.col("_hot.component_id").alias("component_id")).unionByName(rest.select("fp", "doc_id", "component_id"))
    return every.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
