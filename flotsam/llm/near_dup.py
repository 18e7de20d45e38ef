"""N-gram Jaccard join: MinHash banding, shuffle on band hashes, pairs verified on full n-gram sets."""
from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from flotsam.llm.common import WHITE, row_key, slices, text_of
from flotsam.operators.components import connected_components
from flotsam.session import materialise

WORDS = 5               # words of an n-gram
SIMILARITY = (4, 5)     # Jaccard similarity of a link as a fraction, so that it is compared in whole numbers
ROWS = 8                # rows of a band
RECALL = 0.9995         # chance that a pair exactly at the threshold meets in some band
BLOCK = 256             # texts that are compared with as many others in one step
SMALL_TABLE = 1_000_000     # rows of a key table that may be broadcast; larger ones are shuffled

_POWERS = np.array([pow(0x9E3779B97F4A7C15, i + 1, 1 << 64) for i in range(512)], np.uint64)
_FOLD = np.uint64(0xFF51AFD7ED558CCD)


def bands_for(similarity: float, recall: float, rows: int) -> int:
    """Fewest bands of ``rows`` rows in which a pair of that similarity meets at least once with chance ``recall``."""
    return math.ceil(math.log(1 - recall) / math.log(1 - similarity ** rows))


def _mix(h: np.ndarray) -> np.ndarray:
    h ^= h >> np.uint64(33)
    h *= _FOLD
    h ^= h >> np.uint64(29)
    return h


_WHITE = np.zeros(0x110000, bool)
_WHITE[[ord(c) for c in WHITE]] = True


def word_hashes(text: str, piece: int = 1 << 18) -> np.ndarray:
    """64-bit hash of every word (run without white space); a long text is read in pieces that end at white space."""
    out, at = [], 0
    while at < len(text):
        end = min(at + piece, len(text))
        while end < len(text) and text[end] not in WHITE:
            end += 1
        points = np.frombuffer(text[at:end].encode("utf-32-le"), "<u4")
        at = end
        inside = ~_WHITE[points]
        edge = np.diff(inside.astype(np.int8), prepend=0, append=0)
        begin, stop = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
        if len(begin):
            size = stop - begin
            where = np.flatnonzero(inside)
            values = (points[where].astype(np.uint64) + np.uint64(1)) * _POWERS[(where - np.repeat(begin, size)) & 511]
            first = np.cumsum(size) - size
            out.append(_mix(np.add.reduceat(values, first) ^ size.astype(np.uint64)))
    return np.concatenate(out) if out else np.zeros(0, np.uint64)


def shingles(text: str, words: int = WORDS) -> np.ndarray:
    """Sorted different hashes of the text's word n-grams. A text with fewer words has one, of all its words; a text
    without a word has none."""
    w = word_hashes(text)
    m = len(w) - words + 1
    if not len(w):
        return w
    if m <= 0:
        m, words = 1, len(w)
    h = np.full(m, words, np.uint64)
    for j in range(words):
        h = h * _POWERS[0] + w[j:m + j]
    return np.unique(_mix(h))


def _signatures(words: int, bands: int, rows: int):
    def run(batches):
        rng = np.random.default_rng(11)
        flip = rng.integers(0, 1 << 32, bands * rows, dtype=np.uint64).astype(np.uint32)
        spread = rng.integers(0, 1 << 32, bands * rows, dtype=np.uint64).astype(np.uint32) | np.uint32(1)
        salt = _mix(np.arange(1, bands + 1, dtype=np.uint64))
        for batch in batches:
            for b in slices(batch, "_text"):
                node, low, has = np.zeros(b.num_rows, np.int64), np.zeros((b.num_rows, bands * rows), np.uint32), np.zeros(b.num_rows, bool)
                for i, t in enumerate(b.column("_text")):
                    s = shingles(t.as_py() or "", words)
                    if not len(s):
                        continue
                    has[i] = True
                    node[i] = int.from_bytes(hashlib.blake2b(s.tobytes(), digest_size=8).digest(), "little", signed=True)
                    x = (s >> np.uint64(32)).astype(np.uint32)
                    least = np.full(bands * rows, 0xFFFFFFFF, np.uint32)
                    for k in range(0, len(x), 1024):
                        np.minimum(least, ((x[k:k + 1024, None] ^ flip) * spread).min(0), out=least)
                    low[i] = least
                h = np.repeat(salt[None, :], b.num_rows, 0)
                for j in range(rows):
                    h = _mix(h ^ low[:, j::rows].astype(np.uint64) * _POWERS[1])
                ends = np.concatenate([[0], np.cumsum(has * bands)]).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(h[has].ravel().view(np.int64)))
                yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("_key"), pa.array(node, mask=~has), lists], ["doc_id", "_key", "node", "bands"])
    return run


def _compare(a: list[np.ndarray], b: list[np.ndarray]) -> np.ndarray:
    """Whether the Jaccard similarity of each of ``a`` with each of ``b`` reaches the threshold, on the full sets."""
    sizes = np.array([len(s) for s in a + b])
    _, col, times = np.unique(np.concatenate(a + b), return_inverse=True, return_counts=True)
    owner = np.repeat(np.arange(len(sizes)), sizes)
    shared = np.flatnonzero(times > 1)          # the others add nothing to an intersection
    number = np.full(len(times), -1)
    number[shared] = np.arange(len(shared))
    keep = number[col] >= 0
    owner, col = owner[keep], number[col[keep]]
    order = np.argsort(col, kind="stable")
    owner, col = owner[order], col[order]
    both = np.zeros((len(a), len(b)), np.float32)
    for k in range(0, len(shared), 4096):
        lo, hi = np.searchsorted(col, [k, k + 4096])
        m = np.zeros((len(sizes), min(4096, len(shared) - k)), np.float32)
        m[owner[lo:hi], col[lo:hi] - k] = 1
        both += m[:len(a)] @ m[len(a):].T
    inter = np.rint(both).astype(np.int64)
    union = sizes[:len(a), None] + sizes[None, len(a):] - inter
    return inter * SIMILARITY[1] >= union * SIMILARITY[0]


def _labels(link: np.ndarray) -> np.ndarray:
    """Component (as its first member) of every node of a symmetric link matrix."""
    label = np.full(len(link), -1)
    for i in range(len(link)):
        if label[i] < 0:
            front = np.array([i])
            label[i] = i
            while len(front):
                front = np.flatnonzero(link[front].any(0) & (label < 0))
                label[front] = i
    return label


def _verify(t: pa.Table) -> pa.Table:
    """Links inside one task's block pairs: per text the documents it is linked to and its component there."""
    group, i, j, block = (t[c].to_numpy() for c in ("group", "i", "j", "block"))
    node, weight = t["node"].to_numpy(), t["weight"].to_numpy()
    sets = [np.frombuffer(s.as_py(), "<u8") for s in t["set"]]
    order = np.lexsort((node, block, j, i, group))
    key = np.stack([group[order], i[order], j[order]])
    cut = [0, *(np.flatnonzero((key[:, 1:] != key[:, :-1]).any(0)) + 1).tolist(), len(order)]
    nodes, links, firsts = [], [], []
    for lo, hi in zip(cut, cut[1:]):
        m = order[lo:hi]
        left, right = m[block[m] == i[m[0]]], m[block[m] == j[m[0]]]
        link = np.zeros((len(m), len(m)), bool)
        if i[m[0]] == j[m[0]]:
            link = _compare([sets[k] for k in m], [sets[k] for k in m])
        elif len(left) and len(right):
            link[:len(left), len(left):] = _compare([sets[k] for k in left], [sets[k] for k in right])
            link |= link.T
        np.fill_diagonal(link, False)
        nodes.append(node[m])
        links.append(link @ weight[m])
        firsts.append(node[m][_labels(link)])
    return pa.table({"node": np.concatenate(nodes), "links": np.concatenate(links).astype(np.int64), "first": np.concatenate(firsts)})


def _with_sets(docs: DataFrame, wanted: DataFrame, id_col: str, text_col: str, words: int) -> DataFrame:
    """``node, set``: the full n-gram set of one document of every wanted node (``node, _key``)."""
    side = F.broadcast(wanted) if wanted.count() <= SMALL_TABLE else wanted
    found = docs.select(text_of(text_col).alias("_text"), row_key(id_col, text_col).alias("_key")).join(side, "_key").select("node", "_text")

    def run(batches):
        for batch in batches:
            for b in slices(batch, "_text"):
                yield pa.RecordBatch.from_arrays([b.column("node"), pa.array([shingles(t.as_py(), words).astype("<u8").tobytes() for t in b.column("_text")], pa.binary())], ["node", "set"])

    return found.mapInArrow(run, "node long, set binary").dropDuplicates(["node"])


def near_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS, rows: int = ROWS, recall: float = RECALL) -> DataFrame:
    """One row per document: ``doc_id, class_id, copy_id, n_links`` and ``_key`` (the key of the row).

    Two documents are linked when the Jaccard similarity of their sets of word n-grams is 0.8 or more. ``n_links`` is
    the number of other documents a document is linked to, ``class_id`` the smallest id among all that links connect
    it with, ``copy_id`` the smallest id with exactly its set. Documents with one set are one node from the start, so
    copies are never compared. Nodes that share a band hash are candidates; what candidates connect is compared all
    against all, in pairs of blocks of ``BLOCK`` texts, as products of 0/1 matrices over the n-grams that occur twice: a
    group of m near copies costs (m / BLOCK)**2 block products and sends back one row per text and block, never its
    pairs. The bands are chosen for the recall at the threshold; verification is exact on the full sets
    (n-grams and sets are told apart by 64-bit hashes).

    Words are runs without white space, case kept. Texts with fewer than ``words`` words have one n-gram; texts
    without words (null, empty, blank) have none and stand alone. Null ids are allowed and never a ``class_id`` unless
    a class has no other. Repeated rows are documents of their own. No rows give no rows; other columns are ignored.
    """
    bands = bands_for(SIMILARITY[0] / SIMILARITY[1], recall, rows)
    thin = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), row_key(id_col, text_col).alias("_key"), text_of(text_col).alias("_text"))
    signed = materialise(thin.mapInArrow(_signatures(words, bands, rows), "doc_id long, _key string, node long, bands array<long>"))
    # one band hash suffices to pick a node's bands: all rows of a node have the same
    nodes = materialise(signed.where(F.col("node").isNotNull()).groupBy("node").agg(
        F.count(F.lit(1)).alias("weight"), F.min("doc_id").alias("copy_id"), F.min("_key").alias("_key")))
    lead = signed.select("node", "_key", "bands").join(nodes.select("node", "_key"), ["node", "_key"]).dropDuplicates(["node"])
    spread = materialise(lead.select("node", F.explode("bands").alias("band")))
    shared = materialise(spread.groupBy("band").agg(F.count(F.lit(1)).alias("_n"), F.min("node").alias("first")).where(F.col("_n") > 1).select("band", "first"))
    stars = spread.join(shared, "band").select("node", "first").distinct()
    linked = materialise(connected_components(stars, "node", "first"))

    sizes = linked.groupBy("component").agg(F.count(F.lit(1)).alias("_m"))
    placed = (linked.join(materialise(sizes), "component").join(nodes, "node")
              .select("node", "weight", "_key", F.col("component").alias("group"), F.ceil(F.col("_m") / BLOCK).cast("int").alias("_blocks")))
    placed = materialise(placed.withColumn("block", F.pmod(F.xxhash64("node"), F.col("_blocks")).cast("int")))
    whole = placed.join(_with_sets(docs, placed.select("node", "_key"), id_col, text_col, words), "node")
    dealt = whole.withColumn("_other", F.explode(F.sequence(F.lit(0), F.col("_blocks") - 1))).select(
        "node", "weight", "group", "set", "block", "_blocks", F.least("block", "_other").alias("i"), F.greatest("block", "_other").alias("j"))
    # groups of one block share tasks of about BLOCK texts, every other pair of blocks is a task
    tasks = max(1, placed.count() // BLOCK)
    task = F.when(F.col("_blocks") == 1, F.pmod(F.xxhash64("group"), F.lit(tasks))).otherwise(F.xxhash64("group", "i", "j"))
    checked = materialise(dealt.withColumn("_task", task).drop("_blocks").groupBy("_task").applyInArrow(_verify, "node long, links long, first long"))
    links = checked.groupBy("node").agg(F.sum("links").alias("links"))
    joined = connected_components(checked.where(F.col("node") != F.col("first")).select("node", "first"), "node", "first")

    of_node = (nodes.join(links, "node", "left").join(joined, "node", "left")
               .select("node", "copy_id", (F.coalesce("links", F.lit(0)) + F.col("weight") - 1).alias("n_links"), F.coalesce("component", "node").alias("_class")))
    of_node = materialise(of_node)
    named = materialise(of_node.groupBy("_class").agg(F.min("copy_id").alias("class_id")))
    of_node = materialise(of_node.join(named, "_class").drop("_class"))
    return signed.select("doc_id", "_key", "node").join(of_node, "node", "left").select(
        "doc_id", "_key", "node", F.when(F.col("node").isNull(), F.col("doc_id")).otherwise(F.col("class_id")).alias("class_id"),
        F.when(F.col("node").isNull(), F.col("doc_id")).otherwise(F.col("copy_id")).alias("copy_id"), F.coalesce("n_links", F.lit(0)).alias("n_links"))


def drop_near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, with their columns, of which one stays per class: the one with the smallest id."""
    g = materialise(near_groups(docs, id_col, text_col))
    alone = F.col("node").isNull()
    order = F.struct(F.col("doc_id").isNull().alias("n"), "doc_id", "_key")
    best = g.where(~alone).groupBy("class_id", F.when(F.col("class_id").isNull(), F.col("node")).alias("_n")).agg(F.min(order).alias("o"))
    keep = materialise(best.select(F.col("o._key").alias("_keep"), F.lit(True).alias("_once")).unionByName(
        g.where(alone).select(F.col("_key").alias("_keep"), F.lit(False).alias("_once")).distinct()))
    d = docs.select(F.struct(*docs.columns).alias("doc"), row_key(id_col, text_col).alias("_key")).join(keep, F.col("_key") == F.col("_keep"))
    # repeated rows share a key: one of them stays
    again = F.row_number().over(Window.partitionBy("_key").orderBy(F.lit(1)))
    return d.withColumn("_row", again).where(~F.col("_once") | (F.col("_row") == 1)).select("doc.*")
