"""SimHash links, heap-ordered clusters and spelling variants against brute force; windows and words of long texts."""
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

from flotsam.llm import bpe, grams, heap_kmeans, quality, simhash, spelling
from flotsam.llm.queries import QUERIES, cluster_sql, public_tokenizer
from test_operators import SCHEMA, docs, make_rows, none, random_text, rows, tok      # noqa: F401
from oracle_check import rows_of

WORDS = re.compile(r"[^\x20\x09-\x0D]+")


def ascii_lower(t):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t)


# fingerprints

def plain_fingerprint(text):
    w = WORDS.findall(ascii_lower(text or ""))
    s = [" ".join(w[i:i + 3]) for i in range(len(w) - 2)] if len(w) >= 3 else [" ".join(w)] if w else []
    h = [xxhash.xxh64(x.encode(), seed=42).intdigest() for x in s]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def plain_components(values, budget=3):
    label = np.arange(len(values))
    near = np.bitwise_count(values[:, None] ^ values[None, :]) <= budget
    while True:
        new = np.array([label[near[i]].min() for i in range(len(values))])
        if (new == label).all():
            return label
        label = new


def from_links(values, x, y):
    at = {int(f): i for i, f in enumerate(values)}
    root = list(range(len(values)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i
    for a, b in zip(x, y):
        i, j = find(at[int(a)]), find(at[int(b)])
        root[max(i, j)] = min(i, j)
    return np.array([find(i) for i in range(len(values))])


def clustered(rng, n):
    v = list(rng.integers(0, 1 << 64, n // 5, dtype=np.uint64))
    while len(v) < n:
        f = int(v[rng.integers(len(v))])
        for b in rng.integers(0, 64, rng.integers(1, 6)):
            f ^= 1 << int(b)
        v.append(np.uint64(f))
    return np.unique(np.array(v, np.uint64))


@pytest.mark.parametrize("front", [3, 60, 1 << 16])
def test_trie_join_is_brute_force(front):
    rng = np.random.default_rng(front)
    for _ in range(8):
        v = clustered(rng, 250)
        assert (plain_components(v) == from_links(v, *simhash.join_tries(v, v, 0, 0, front=front))).all()
        # two subtrees: only links between them count
        a, b = v[v < 1 << 63], v[v >= 1 << 63]
        x, y = simhash.join_tries(a, b, 1, 1, front=front)
        across = [(p, q) for p in a for q in b if int(p ^ q).bit_count() <= 3]
        assert (from_links(v, x, y) == from_links(v, *zip(*across))).all() if across else len(x) == 0


def test_a_dense_ball_costs_one_link_per_fingerprint():
    base = np.uint64(0x123456789ABCDEF0)
    ball = np.unique(np.array([base] + [base ^ np.uint64(1 << i) ^ np.uint64(1 << j) for i in range(64) for j in range(64)], np.uint64))
    x, _ = simhash.join_tries(ball, ball, 0, 0, front=500)
    assert len(x) == len(ball) - 1


@pytest.mark.parametrize("block", [1 << 18, 6])
def test_subtrees_lose_no_link(spark, block):
    v = clustered(np.random.default_rng(8), 600)
    fps = spark.createDataFrame([(int(f),) for f in v.view(np.int64)], "fp long")
    got = simhash.links(fps, block=block).collect()
    x, y = (np.array([r[i] for r in got], np.int64).view(np.uint64) for i in (0, 1))
    assert (plain_components(v) == from_links(v, x, y)).all()


def test_simhash_groups(spark, docs, rows, none):      # noqa: F811
    got = simhash.near_groups(docs).collect()
    fp = [plain_fingerprint(r[1]) for r in rows]
    assert Counter((g.doc_id, g.fingerprint) for g in got) == Counter((r[0], f"{f:016x}") for r, f in zip(rows, fp))
    values = np.unique(np.array(fp, np.uint64))
    label = plain_components(values)
    of = {int(f): int(c) for f, c in zip(values, label)}
    least = {}
    for r, f in zip(rows, fp):
        if r[0] is not None:
            least[of[f]] = min(least.get(of[f], r[0]), r[0])
    assert {(g.doc_id, g.component_id) for g in got} == {(r[0], least.get(of[f])) for r, f in zip(rows, fp)}
    assert any(n > 1 for n in Counter(of.values()).values())         # something is linked beyond equal fingerprints
    assert simhash.near_groups(none).count() == 0


@pytest.mark.parametrize("piece", [5, 64])
def test_fingerprint_of_a_long_text_in_pieces(piece):
    rnd = random.Random(piece)
    for _ in range(60):
        t = "".join(rnd.choice("abAB é\n\t") for _ in range(rnd.randint(0, 300)))
        assert simhash.fingerprint(t, piece=piece) == simhash.fingerprint(t) == plain_fingerprint(t)


# clusters

VECTORS = "vec_id long, embedding array<float>, label int, cluster int, block string"


def vector_rows():
    rng = np.random.default_rng(4)
    centre = rng.normal(0, 1, (5, 64))
    out = [(i, (centre[i % 5] + rng.normal(0, 0.6, 64)).astype(np.float32).tolist()) for i in range(700)]
    out += [(900 + i, out[3][1]) for i in range(60)] + [out[7]] * 4 + [(None, out[8][1])]
    out += [(800, None), (801, [1.0] * 63), (802, [1.0] * 63 + [None]), (803, [1.0] * 63 + [float("nan")]), (804, [float("inf")] + [0.0] * 63), (805, [0.0] * 64)]
    return [(*r, 1, 2, "x") for r in out]


@pytest.fixture(scope="module")
def duck_clusters():
    import duckdb

    def run(frame, k, rounds):
        con = duckdb.connect()
        table = pa.table({"vec_id": pa.array([r[0] for r in frame], pa.int64()), "embedding": pa.array([r[1] for r in frame], pa.list_(pa.float32()))})
        con.register("embeddings", table)
        cur = con.execute(cluster_sql(k, rounds))
        return rows_of([d[0] for d in cur.description], cur.fetchall())
    return run


@pytest.mark.parametrize("k,rounds", [(8, 10), (3, 2), (1, 3), (900, 1)])
def test_clusters_are_lloyds(spark, duck_clusters, monkeypatch, k, rounds):
    monkeypatch.setattr(heap_kmeans, "BLOCK", 50)
    frame = vector_rows()
    got = heap_kmeans.cluster(spark.createDataFrame(frame, VECTORS).repartition(3), k=k, rounds=rounds)
    assert rows_of(got.columns, [tuple(r) for r in got.collect()]) == duck_clusters(frame, k, rounds)


def test_no_vectors_no_clusters(spark):
    assert heap_kmeans.cluster(spark.createDataFrame([], VECTORS)).count() == 0
    assert heap_kmeans.cluster(spark.createDataFrame([(1, [1.0], 1, 1, "x")], VECTORS)).count() == 0
    with pytest.raises(Exception, match="beyond"):
        heap_kmeans.cluster(spark.createDataFrame([(1, [1e9] * 64, 1, 1, "x")], VECTORS)).count()


def test_bounds_spare_most_scans():
    """Heaps survive a round trip, and well-parted clusters are hardly looked at again."""
    rng = np.random.default_rng(2)
    centre = rng.integers(-3000, 3000, (6, 64))
    v = (centre[rng.integers(0, 6, 3000)] + rng.integers(-300, 300, (3000, 64))).astype(np.int32)
    c = (centre + rng.integers(-200, 200, centre.shape)).astype(np.int64)
    b, drift, sums, scans = heap_kmeans.Bounds.fresh(len(v), 6), np.zeros(6), np.zeros((6, 65), np.int64), []
    for _ in range(6):
        before = [len(h) for h in b.heaps]
        waiting = sum(1 for h, d in zip(b.heaps, drift) for key, _ in h if key <= d * (1 + heap_kmeans.MARGIN))
        scans.append(waiting)
        sums += b.assign(v, c, drift)
        want = np.stack([heap_kmeans.squared(v, x) for x in c], 1).argmin(1)
        assert (b.cluster == want).all() and sum(before) == sum(len(h) for h in b.heaps) == len(v)
        new = sums[:, :64] // np.maximum(sums[:, 64:], 1)
        drift, c = drift + heap_kmeans._drifts(c, new), new
        b = heap_kmeans.Bounds.load(*b.dump())
    assert scans[0] == len(v) and sum(scans[1:]) < len(v) // 10


# spelling

def plain_words(rows):
    n = Counter()
    for i, text in ((r[0], r[1]) for r in rows):
        for w in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            w = ascii_lower(w)
            h = zlib.crc32(f"{'' if i is None else i}:{w}".encode())
            if h % 199 == 0:
                k = h % len(w)
                w = w[:k] + w[k + 1:]
            n[w] += 1
    return {w: k for w, k in n.items() if k >= 5 and len(w) >= 6}


def one_edit(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1:] == a for i in range(len(b)))


def plain_variants(n):
    near = {w: [x for x in n if one_edit(w, x)] for w in n}
    form = {}
    for w in n:
        if near[w]:
            best = min(near[w], key=lambda x: (-n[x], x))
            if n[best] >= 5 * n[w]:
                form[w] = best
    out = set()
    for w in n:
        root = w
        while root in form:
            root = form[root]
        out.add((w, form.get(w), root, n[w], len(near[w]), n[form[w]] if w in form else None))
    return out


def spelling_rows():
    rnd = random.Random(6)
    stems = ["harbour", "seaweed", "plastics", "éclairée", "straße", "ÀÉÎÕÜß", "a" * 40, "floating"]
    out = []
    for i in range(500):
        words = []
        for _ in range(rnd.randint(0, 60)):
            w = rnd.choice(stems)
            if rnd.random() < 0.25:
                k = rnd.randrange(len(w))
                w = rnd.choice([w[:k] + w[k + 1:], w[:k] + rnd.choice("aeü") + w[k:], w[:k] + rnd.choice("xeé") + w[k + 1:], w[::-1], w.upper()])
            words.append(w)
        out.append((i if i % 50 else None, rnd.choice([" ", "-", "漢", "1"]).join(words)))
    out += [(1000, None), (1001, ""), (1002, "harbour " * 30000), *[(1100 + i, "harbours " * 60 + "harbourss") for i in range(12)], (3, out[3][1]), (3, out[3][1])]
    return [(i, t, "en", "a", 1, 0.5, "k", "d") for i, t in out]


@pytest.mark.parametrize("chunk,piece", [(1 << 14, 1 << 20), (60, 50)])
def test_variants_are_brute_force(spark, monkeypatch, chunk, piece):
    monkeypatch.setattr(spelling, "CHUNK", chunk)
    rows = spelling_rows()      # noqa: F811
    got = spelling.variants(spark.createDataFrame(rows, SCHEMA).repartition(3)).collect()
    want = plain_variants(plain_words(rows))
    assert {tuple(g) for g in got} == want and len(got) == len(want)
    assert any(r[1] is not None and r[1] != r[2] for r in want) and any(r[4] > 1 for r in want)
    assert [p for p in spelling.pieces("ab " * 40, 7)] and "".join(spelling.pieces("ab " * 40, 7)) == "ab " * 40


def test_letter_counts_keep_every_near_pair():
    rng = np.random.default_rng(5)
    words = sorted({bytes(rng.integers(97, 100, rng.integers(6, 9)).astype(np.uint8)) for _ in range(400)})
    for la, lb in ((6, 6), (6, 7), (7, 7), (7, 8)):
        a, b = ([w for w in words if len(w) == n] for n in (la, lb))
        i, j = spelling._near(np.array([list(w) for w in a], np.uint8), np.array([list(w) for w in b], np.uint8), la == lb, step=64)
        want = {(p, q) for p in range(len(a)) for q in range(p + 1 if la == lb else 0, len(b)) if one_edit(a[p].decode(), b[q].decode())}
        assert set(zip(i.tolist(), j.tolist())) == want


def test_no_words_no_variants(none):        # noqa: F811
    assert spelling.variants(none).count() == 0


# long texts and samples

@pytest.mark.parametrize("n", [2, 3, 4])
def test_every_window_is_seen_once(monkeypatch, n):
    monkeypatch.setattr(grams, "BITE", 50)
    rnd = random.Random(n)
    texts = ["".join(rnd.choice("abcİΣ ") for _ in range(k)) for k in (0, 1, 3, 49, 50, 51, 180, 400)]
    got = Counter()
    for rows, points, starts, seen in grams.bites(pa.array(texts), 4 - 1):       # noqa: F811
        h = grams.char_grams(points, n)
        pos, part = grams.positions_inside(np.arange(len(h)), n, starts, seen)
        got.update((int(rows[p]), bytes(points[x:x + n].tobytes())) for x, p in zip(pos, part))
    want = Counter((i, t.lower()[k:k + n].encode("utf-32-le")) for i, t in enumerate(texts) for k in range(len(t.lower()) - n + 1))
    assert got == want


def test_words_stay_whole_and_scores_do_not_depend_on_bites(monkeypatch):
    texts = pa.array(["word " * 900, "one\ntwo  three", "", "x" * 700])
    whole = quality.raw_features(texts, np.full(4, np.nan))
    monkeypatch.setattr(grams, "BITE", 33)
    for a, b in zip(whole, quality.raw_features(texts, np.full(4, np.nan))):
        assert np.array_equal(a, b, equal_nan=True)


def test_a_repeated_id_is_sampled_once(spark):
    d = spark.range(100000).select(F.lit(7).cast("long").alias("doc_id"), F.lit("same id").alias("text")).unionByName(
        spark.createDataFrame([(1, "a"), (2, "b")], "doc_id long, text string"))
    labels = spark.createDataFrame([(7, 1), (7, 1), (1, 0), (2, 0)], "doc_id long, toxic int")
    got = grams.labelled_sample(d, labels, "toxic", F.lit(True), 10).collect()
    assert sorted((r.text, r.y) for r in got) == [("a", 0), ("b", 0), ("same id", 1)]


def test_every_text_goes_through_the_transducer(tok, monkeypatch):     # noqa: F811
    read = []
    push = bpe.Transducer.push
    monkeypatch.setattr(bpe.Transducer, "push", lambda self, parts, more: read.extend(parts) or push(self, parts, more))
    monkeypatch.setattr(bpe, "PIECE", 50)
    rnd = random.Random(1)
    texts = ["", "x" * 400, *[random_text(rnd, rnd.randint(0, 200)) for _ in range(40)]]
    assert "".join(read) != "".join(texts)
    from tokenizers import Tokenizer
    library = Tokenizer.from_str(public_tokenizer())
    for t, ids in zip(texts, bpe.encode_texts(tok, texts)):
        assert ids.tolist() == library.encode(t, add_special_tokens=False).ids
    assert "".join(read) == "".join(texts)


def test_digests_are_those_of_the_whole(spark, docs):       # noqa: F811
    spec = public_tokenizer()
    a = bpe.digests(docs, spec)
    b = bpe.round_trip(docs, spec).select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
    assert Counter(map(tuple, a.collect())) == Counter(map(tuple, b.collect()))


def test_new_queries_have_their_columns(spark, sf):
    want = {"op11_simhash": {"doc_id", "fingerprint", "component_id"}, "op12_clusters": {"vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"},
            "op13_spelling": {"word", "form", "root", "n", "n_near", "form_n"}}
    for name, columns in want.items():
        assert columns <= set(QUERIES[name](spark, sf).columns)
