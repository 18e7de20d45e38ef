"""Training-data operators against brute force, on small tables with nulls, empty and long texts, ties and repeated rows."""
import hashlib
import json
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from flotsam.llm import bpe, exact_dedup, hnsw, kd_shards, language, licences, mixing, near_dup, quality, toxicity
from flotsam.llm.common import fold
from flotsam.llm.queries import QUERIES, public_tokenizer

WS = re.compile(r"[\x20\x09-\x0D]+")
WORDS = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double, _key string, doc string"


def sentence(rnd, n):
    return " ".join(rnd.choice("alpha beta gamma delta omega kappa sigma theta lambda epsilon".split()) + str(rnd.randint(0, 400)) for _ in range(n))


def make_rows():
    rnd = random.Random(3)
    rows = []
    for i in range(150):
        rows.append([i, sentence(rnd, rnd.randint(1, 80)), rnd.choice(["en", "de", None]), rnd.choice(["a", "a", "a", "b", "c", None]), rnd.choice([None, 5, 900])])
    base = sentence(rnd, 120)
    for i in range(150, 190):                       # near copies: one or two words differ
        w = base.split()
        for _ in range(rnd.randint(1, 2)):
            w[rnd.randrange(len(w))] = f"new{i}"
        rows.append([i, " ".join(w), "en", "a", 1])
    for i in range(190, 230):                       # copies up to white space
        rows.append([i, base + " " * (i % 3), "en", "a", 2])
    rows += [[300, None, None, None, None], [301, "", "en", "a", 0], [302, " \n", "en", "a", 2], [303, "one two", "en", "b", 7], [304, "two\tone", "en", "b", 7],
             [305, sentence(rnd, 60000), "en", "c", 1], [None, "no id here at all, is there", "en", "c", 1], [None, None, None, None, None],
             [303, "one two", "en", "b", 7], [306, "é漢 😀 don't <|endoftext|> x  ", "fr", "z", 3]]
    return [tuple([*r, 0.5, "k", "d"]) for r in rows]


@pytest.fixture(scope="module")
def rows():
    return make_rows()


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


# tokens

@pytest.fixture(scope="module")
def tok():
    return bpe.tokenizer(public_tokenizer())


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_str(public_tokenizer())


def random_text(rnd, n):
    return "".join(rnd.choice(list("ab '\n\tsredlvm.,!1é漢 ́😀")) for _ in range(n))


def test_bpe_is_the_librarys(tok, library):
    rnd = random.Random(1)
    texts = ["", " ", "it's   ", "''s", "\n's", "a <|endoftext|> b<|endoftext|>", "x" * 900, " " * 500 + "y", "=-" * 700] + [random_text(rnd, rnd.randint(1, 60)) for _ in range(1500)]
    for t, ids in zip(texts, bpe.encode_texts(tok, texts)):
        assert ids.tolist() == library.encode(t, add_special_tokens=False).ids, t
        assert "".join(bpe.decode_pieces(tok, ids, 3)) == t


@pytest.mark.parametrize("piece", [40, 333])
def test_bpe_stream_holds_little_and_agrees(tok, library, monkeypatch, piece):
    monkeypatch.setattr(bpe, "PIECE", piece)
    rnd = random.Random(2)
    long = "".join(rnd.choice("abcdefghij") for _ in range(12000))
    for t in [long, "a" * 9000, " " * 7000 + "x", "漢" * 3000, "\n " * 2500 + "'s", *[random_text(rnd, 400) for _ in range(60)]]:
        parts = list(bpe.encode_stream(tok, (t[i:i + piece] for i in range(0, len(t), piece))))
        assert np.concatenate(parts).tolist() == library.encode(t, add_special_tokens=False).ids


def test_lookahead_suffices_for_cut_texts(tok):
    """Tokens that end before the lookahead do not depend on what follows."""
    rnd = random.Random(4)
    for _ in range(40):
        front = "".join(rnd.choice("ethanoing") for _ in range(tok.lookahead + 200)).encode()
        stable, rest = tok.stable(front)
        assert sum(len(tok.bytes_of[t]) for t in stable) + len(rest) == len(front) and stable
        for _ in range(3):
            more = front + "".join(rnd.choice("ethanoing") for _ in range(80)).encode()
            assert tok.word(more)[:len(stable)] == stable


def test_lookahead_of_a_chain():
    assert bpe.sufficient_lookahead([(b"c", b"d"), (b"b", b"c"), (b"a", b"b")]) == 3       # ab|c|d hangs on d
    assert bpe.sufficient_lookahead([(b"a", b"b"), (b"b", b"c"), (b"c", b"d")]) == 1


def test_decode_of_broken_bytes(tok):
    half = tok.byte_id[0xC3]
    assert "".join(bpe.decode_pieces(tok, np.array([half, tok.byte_id[ord("a")], half], np.uint32), 1)) == "�a�"


def test_bpe_frame(spark, docs, rows, library, none):
    spec = public_tokenizer()
    t = bpe.encode(docs, spec)
    got = t.select("doc_id", "n_tokens", "ids", bpe.decode(t, spec).alias("back")).collect()
    want = sorted(((r[0] is None, r[0] or 0, library.encode(r[1] or "", add_special_tokens=False).ids, r[1] or "") for r in rows), key=repr)
    assert sorted(((g.doc_id is None, g.doc_id or 0, np.frombuffer(bytes(g.ids), "<u4").tolist(), g.back) for g in got), key=repr) == want
    assert bpe.encode(none, spec).count() == 0


# copies

def test_exact_copies(docs, rows, none):
    groups = {}
    for r in rows:
        groups.setdefault(WS.sub("", r[1] or ""), []).append(r)
    got = exact_dedup.mark_copies(docs, salts=3).collect()
    assert len(got) == len(rows)
    kept = {}
    for g in got:
        kept[g.text_sha256] = kept.get(g.text_sha256, 0) + g.kept
    for norm, members in groups.items():
        sha = hashlib.sha256(norm.encode()).hexdigest()
        best = min(members, key=lambda r: (-len(r[1] or ""), r[0] is None, r[0] or 0))
        mine = [g for g in got if g.text_sha256 == sha]
        assert {(g.keep_id, g.group_size) for g in mine} == {(best[0], len(members))} and kept[sha] == 1
    left = exact_dedup.drop_copies(docs)
    assert left.columns == docs.columns and left.count() == len(groups)
    assert exact_dedup.mark_copies(none).count() == 0 and exact_dedup.drop_copies(none).count() == 0


def sets_of(rows):
    out = []
    for r in rows:
        w = WORDS.findall(r[1] or "")
        k = min(5, len(w))
        out.append({tuple(w[i:i + k]) for i in range(len(w) - k + 1)} if w else set())
    return out


def test_near_copies(docs, rows, none, monkeypatch):
    monkeypatch.setattr(near_dup, "BLOCK", 16)      # the large group is compared in several blocks
    sets, n = sets_of(rows), len(rows)
    linked = [[i != j and bool(sets[i]) and bool(sets[j]) and 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j]) for j in range(n)] for i in range(n)]
    label = list(range(n))
    for _ in range(n):
        new = [min([label[i]] + [label[j] for j in range(n) if linked[i][j]]) for i in range(n)]
        if new == label:
            break
        label = new
    smallest = {}
    for i in range(n):
        if rows[i][0] is not None:
            smallest[label[i]] = min(smallest.get(label[i], 1 << 60), rows[i][0])
    want = sorted(((rows[i][0], smallest.get(label[i]), sum(linked[i])) for i in range(n)), key=repr)
    got = near_dup.near_groups(docs)
    assert sorted(((g.doc_id, g.class_id, g.n_links) for g in got.collect()), key=repr) == want
    left = near_dup.drop_near_copies(docs)
    empty = sum(not s for s in sets)
    assert left.columns == docs.columns and left.count() == len({label[i] for i in range(n) if sets[i]}) + empty
    assert near_dup.near_groups(none).count() == 0


def test_bands_reach_the_recall():
    for s, r, rows in ((0.8, 0.9995, 8), (0.5, 0.9, 3)):
        b = near_dup.bands_for(s, r, rows)
        assert 1 - (1 - s ** rows) ** b >= r > 1 - (1 - s ** rows) ** (b - 1)


# mixing and shards

def test_mixing(docs, rows, none):
    got = mixing.mix(docs).select("doc.doc_id", "doc.source", "size", "source_size", "target", "copies").collect()
    assert len(got) == len(rows)
    size = {}
    for r in rows:
        size[r[3]] = size.get(r[3], 0) + len(WORDS.findall(r[1] or ""))
    names = sorted(size, key=lambda s: (s is None, s or ""))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    total, open_, target = sum(size.values()), set(names), {}
    while True:
        left, w = total - sum(target.values()), sum(weight[s] for s in open_)
        over = [s for s in open_ if left * weight[s] / w > 3 * size[s]]
        if not over:
            target |= {s: left * weight[s] / w for s in open_}
            break
        target |= {s: 3.0 * size[s] for s in over}
        open_ -= set(over)
    most = max(g["size"] for g in got)
    taken = {}
    for g in got:
        assert g.source_size == size[g.source] and abs(g.target - target[g.source]) < 1e-6 and g.copies <= 3
        taken[g.source] = taken.get(g.source, 0) + g["size"] * g.copies
    assert sum(taken.values()) <= total and all(abs(taken[s] - target[s]) <= most for s in names)
    again = mixing.mix(docs.repartition(5)).select("doc.doc_id", "doc.text", "copies").collect()
    assert sorted(map(repr, again)) == sorted(map(repr, mixing.mix(docs).select("doc.doc_id", "doc.text", "copies").collect()))
    mixed = mixing.mixed_rows(docs)
    assert mixed.columns == docs.columns and mixed.count() == sum(g.copies for g in got)
    assert mixing.mix(none).count() == 0


@pytest.mark.parametrize("leaves", [1, 7])
def test_shards(docs, rows, none, leaves):
    got = kd_shards.shard_documents(docs.where("doc_id is null or doc_id <> 305"), leaves=leaves).collect()
    assert len(got) == len(rows) - 1 and {g.shard for g in got} == set(range(leaves))
    total = {s: sum(g["size"] for g in got if g.shard == s) for s in range(leaves)}
    assert max(total.values()) - min(total.values()) <= 4 * max(g["size"] for g in got)
    for s in range(leaves):
        assert sorted(g.slot for g in got if g.shard == s) == list(range(sum(g.shard == s for g in got)))
    assert kd_shards.shard_documents(none, leaves=3).count() == 0
    by_bytes = kd_shards.shard_documents(docs, target_bytes=200000).agg(F.max("shard")).first()[0]
    assert by_bytes + 1 == -(-sum(len((r[1] or "").encode()) + 16 for r in rows) // 200000)


# neighbours

def test_neighbours(spark):
    rng = np.random.default_rng(5)
    x = np.round(rng.normal(size=(900, 8)), 3)
    x[300:500] = x[7]
    rows = [(i, v.tolist(), 1.0) for i, v in enumerate(x)]
    rows += [(1000, None, 1.0), (1100, [0.0] * 8, 1.0), (1200, [float("nan")] + [1.0] * 7, 1.0), (1300, [None] + [1.0] * 7, 1.0), (1400, [float("inf")] * 8, 1.0), (None, [1.0] * 8, 1.0),
             (1500, [1.0, 2.0], 1.0), (1501, [1.0, 2.5], 1.0), (1, x[1].tolist(), 1.0)]
    v = spark.createDataFrame(rows, "vec_id long, embedding array<float>, score double")
    got = hnsw.nearest(v, F.coalesce(F.col("vec_id") % 100 == 0, F.lit(False)), shard_rows=200).collect()
    x32 = x.astype(np.float32).astype(np.float64)
    hit = 0
    for q in range(0, 900, 100):
        d = np.sqrt(((x32 - x32[q]) ** 2).sum(1))
        want = [i for i in np.lexsort((np.arange(900), d)) if i != q][:10]
        mine = sorted((g["rank"], g.vec_id, g.score) for g in got if g.query_id == q)
        assert [m[0] for m in mine] == list(range(1, 11)) and all(abs(m[2] - d[m[1]]) < 1e-12 for m in mine)
        assert [(m[2], m[1]) for m in mine] == sorted((m[2], m[1]) for m in mine)
        hit += len({m[1] for m in mine} & set(want))
    assert hit >= 0.9 * 90
    assert [(g.vec_id, g.score) for g in got if g.query_id == 1500] == [(1501, 0.5)]
    assert not {g.query_id for g in got} & {1000, 1100, 1200, 1300, 1400, None}
    assert hnsw.nearest(v.where("false"), F.col("vec_id") % 100 == 0).count() == 0


def test_one_id_with_two_vectors(spark):
    """Every vector of an id gets its own answers; the smallest ids of both are the same."""
    g = np.random.default_rng(5)
    x = np.concatenate([g.normal(size=(1, 4)) + 3, g.normal(size=(1, 4)) + 9, g.normal(size=(30, 4)) + 3, g.normal(size=(30, 4)) + 9])
    ids = [0, 0, *range(1, 61)]
    v = spark.createDataFrame([(i, a.tolist()) for i, a in zip(ids, x)], "vec_id long, embedding array<double>")
    got = sorted((r.rank, r.vec_id, round(r.score, 9)) for r in hnsw.nearest(v, F.col("vec_id") == 0, k=5).collect())
    want = []
    for q in (0, 1):
        d = np.sqrt(((x - x[q]) ** 2).sum(1))
        want += [(n + 1, ids[i], round(float(d[i]), 9)) for n, i in enumerate([i for i in np.argsort(d) if i != q][:5])]
    assert got == sorted(want)


# models

def labelled(spark):
    rnd = random.Random(8)
    docs, labels = [], []
    for i in range(500):
        words = sentence(rnd, rnd.randint(8, 60)).split()
        toxic, junk = i % 3 == 0, i % 4 == 0
        if toxic:
            words[rnd.randrange(len(words))] = "vilewort" + rnd.choice("xyz")
        if junk:
            words = [w.upper() + "!!" for w in words]
        docs.append((i, " ".join(words), "en", "a", None if i % 7 == 0 else 10 * i))
        labels.append((i, int(not junk), int(toxic)))
    docs += [(600, None, None, None, None), (601, "", "en", "a", 0), (602, sentence(rnd, 90000) + " vileworty", "en", "a", 3)]
    labels += [(600, None, None), (None, 1, 1), (601, 1, 0)]
    return spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


@pytest.mark.parametrize("module, label, columns", [(toxicity, "toxic", ["doc_id", "text"]), (quality, "quality", ["doc_id", "text", "n_chars"])])
def test_classifiers(spark, module, label, columns):
    docs, labels = labelled(spark)
    model = module.fit(docs, labels, label, fold(4) != 2)
    got = {r.doc_id: r.score for r in docs.select("doc_id", module.score(model).alias("score")).collect()}
    truth = {r.doc_id: r[label] for r in labels.where("doc_id is not null").collect() if r[label] is not None}
    held = {r.doc_id for r in docs.where(fold(4) == 2).collect()} & truth.keys()
    right = sum((got[i] >= 0.3) == (truth[i] == 1) for i in held)
    assert len(got) == 503 and all(0 <= s <= 1 for s in got.values()) and right >= 0.95 * len(held)
    if label == "toxic":
        assert got[602] >= 0.3 and toxicity.keep_clean(docs, model).columns == docs.columns
    one = module.fit(docs, labels.where(f"{label} = 1"), label, fold(4) != 2)
    assert docs.select(module.score(one).alias("s")).agg(F.min("s")).first()[0] > 0.99
    nothing = module.fit(docs, labels.where("false"), label, fold(4) != 2)
    assert docs.select(module.score(nothing).alias("s")).agg(F.max("s")).first()[0] < 0.01
    assert docs.where("false").select(module.score(model)).count() == 0


def test_interactions_in_linear_time():
    rng = np.random.default_rng(0)
    m = quality.Machine(np.zeros((1, 1)), 0.2, rng.normal(size=30), rng.normal(size=(30, quality.RANK)))
    c, v = np.array([3, 7, 20, 29]), np.array([0.5, 1.0, 2.0, -1.0])
    slow = 0.2 + m.linear[c] @ v + sum(m.factors[c[i]] @ m.factors[c[j]] * v[i] * v[j] for i in range(4) for j in range(i))
    assert abs(m.logit(1, np.zeros(4, np.int64), c, v)[0] - slow) < 1e-9


def test_language(spark):
    rnd = random.Random(9)
    sound = {"aa": ["ba", "na", "ta", "ka"], "bb": ["ri", "zu", "lo", "ki"], "cc": ["çé", "ñó", "üß", "ör"]}
    rows = [(i, " ".join("".join(rnd.choice(sound[lang]) for _ in range(3)) for _ in range(rnd.randint(3, 40))), lang, 0.1)
            for i in range(300) for lang in [rnd.choice(list(sound))]]
    rows += [(900, None, "aa", 0.1), (901, "12 34!", "aa", 0.1), (902, "", None, 0.1), (903, "qqqq", None, 0.1), (904, " ".join(["bananata"] * 90000), None, 0.1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, score double")
    m = language.fit(docs, fold(3) != 1)
    got = {r.doc_id: r.s for r in docs.select("doc_id", language.identify(docs, m).alias("s")).collect()}
    assert all(got[i].lang_pred == lang for i, _, lang, _ in rows[:300])
    assert [got[i].lang_pred for i in (900, 901, 902)] == ["und"] * 3 and got[903].lang_pred in sound and got[903].score == 0
    assert got[904].lang_pred == "aa" and all(0 <= s.score <= 1 for s in got.values())
    blank = language.fit(docs.where("false"), fold(3) != 1)
    assert {r.s.lang_pred for r in docs.select(language.identify(docs, blank).alias("s")).collect()} == {"und"}


def test_bloom_filters_miss_nothing(spark):
    docs = spark.createDataFrame([(i, "banana", "aa") for i in range(20)], "doc_id long, text string, lang string")
    m = language.fit(docs, F.lit(True))
    assert all((m.slots[language._slot(h, s), 0] == 1).all() for n in language.SIZES for s in language.SEEDS
               for h in [language.char_grams(np.frombuffer("banana".encode("utf-32-le"), "<u4"), n)])


# licences

def test_licences(spark):
    mit, gpl = "Released under the MIT License.", "This work is licensed under the GNU General Public License, version 3."
    rows = [("LICENSE", gpl, 1), ("a/LICENSE.txt", f"text\n{mit}\nmore", 1), ("a/b/x.py", "nothing", 1), ("a/b/y.py", "code\n\n# " + gpl, 1), ("c/z.py", None, 1), ("ab/q.py", "", 1),
            (None, "free text", 1), (None, mit, 1), ("a/b/x.py", "nothing", 1), ("d/COPYING", "no licence at all", 1), ("d/e.py", "the license of the party", 1)]
    f = spark.createDataFrame(rows, "path string, text string, licence int")
    got = sorted(((r.file.path or "", r.licence or "", r.origin, r.from_dir if r.from_dir is not None else "-") for r in licences.scan(f).collect()))
    assert got == sorted([("LICENSE", "GPL-3.0", "header", "-"), ("a/LICENSE.txt", "MIT", "header", "-"), ("a/b/x.py", "MIT", "inherited", "a"), ("a/b/x.py", "MIT", "inherited", "a"),
                          ("a/b/y.py", "GPL-3.0", "header", "-"), ("c/z.py", "GPL-3.0", "inherited", ""), ("ab/q.py", "GPL-3.0", "inherited", ""), ("", "", "none", "-"), ("", "MIT", "header", "-"),
                          ("d/COPYING", "GPL-3.0", "inherited", ""), ("d/e.py", "GPL-3.0", "inherited", "")])
    assert licences.scan(f.where("false")).count() == 0


def test_licence_files_headers_and_inline_notices(spark):
    """Whole licence files, header blocks, wrapped and inline notices, standard headings and SPDX ids."""
    text = {p.name.removesuffix(".txt"): p.read_text() for p in licences.TEXTS.glob("*.txt")}
    files = {f"{n}/LICENSE": (f"Copyright (c) 2020 The Foo Authors. All rights reserved.\n\n{t}", n) for n, t in text.items()}
    wrapped = "\n".join(" * " + " ".join(licences.HEADERS[0][1].split()[i:i + 7]) for i in range(0, 80, 7))
    gpl = ("# This program is free software: you can redistribute it and/or modify\n# it under the terms of the GNU General Public License as published by\n# the Free Software Foundation, "
           "either version 3 of the License, or\n# (at your option) any later version.\n#\n# This program is distributed in the hope that it will be useful,\n# but WITHOUT ANY WARRANTY; without "
           "even the implied warranty of\n# MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.  See the\n# GNU General Public License for more details.\n")
    code = "\nimport alpha\nfor beta in gamma(delta):\n    print(epsilon, zeta)\n" * 20
    files |= {"w/a.c": (f"/*\n{wrapped}\n */{code}", "Apache-2.0"), "w/b.py": (gpl + code, "GPL-3.0"), "w/m.py": ("# " + text["MIT"].replace("\n", "\n# ") + code, "MIT"),
              "w/c.md": (f"Alpha beta gamma. Licensed under the MIT License. Delta epsilon zeta eta theta iota.{code}", "MIT"), "w/d.py": (f"# This work is licensed under the\n# GNU General Public License,\n# version 3.{code}", "GPL-3.0"),
              "h/1": ("MIT License" + code, "MIT"), "h/2": ("Apache License" + code, "Apache-2.0"), "h/3": ("GNU GENERAL PUBLIC LICENSE\n  Version 2, June 1991" + code, "GPL-2.0"),
              "h/4": ("Mozilla Public License Version 2.0" + code, "MPL-2.0"), "h/5": ("GNU GENERAL PUBLIC LICENSE" + code, "GPL"), "s/1": ("# SPDX-License-Identifier: Apache-2.0" + code, "Apache-2.0"),
              "s/2": ("// SPDX-License-Identifier: (GPL-2.0-only OR MIT)" + code, "GPL-2.0"), "s/3": ("# SPDX-License-Identifier: Zlib" + code, None), "n/1": ("the license of the party" + code, None),
              "n/2": ("You may copy and distribute the soup in any form, provided that the conditions are met." + code, None), **{f"x/{i}": (f"some other words {i}" + code, None) for i in range(40)}}
    f = spark.createDataFrame([(p, t) for p, (t, _) in files.items()], "path string, text string")
    got = {r.file.path: r.own_licence for r in licences.scan(f).collect()}
    assert got == {p: n for p, (_, n) in files.items()}


def test_telling_terms_lose_nothing():
    words = licences.template_words()
    terms = sorted({t for c in words.values() for t in c})
    idf = {t: 1 + i % 5 for i, t in enumerate(terms)}
    telling = set(licences.telling_terms(words, idf, 0.7))
    for c in words.values():
        rest = {t: n for t, n in c.items() if t not in telling}
        dot, own = sum((n * idf[t]) ** 2 for t, n in rest.items()), sum((n * idf[t]) ** 2 for t, n in c.items())
        assert not rest or dot / (dot ** 0.5 * own ** 0.5) < 0.7


# queries

def test_queries_have_their_columns(spark, sf):
    want = {1: ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"], 2: ["doc_id", "held_out", "score", "predicted"], 3: ["doc_id", "held_out", "score", "predicted"],
            4: ["doc_id", "held_out", "lang_pred", "score"], 5: ["query_id", "rank", "vec_id", "score"], 6: ["doc_id", "size", "source_size", "target", "taken"],
            9: ["doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard"], 10: ["doc_id", "keep_id", "group_size", "kept", "text_sha256"]}
    numbers = sorted(int(n[2:].split("_")[0]) for n in QUERIES)
    assert numbers == list(range(1, 14)) and json.dumps(sorted(QUERIES))
    for n, cols in want.items():
        df = next(q for name, q in QUERIES.items() if name.startswith(f"op{n}_"))(spark, sf)
        assert df.columns[:len(cols)] == cols
