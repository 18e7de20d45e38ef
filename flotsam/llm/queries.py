"""Registered queries of the training-data operators and their DuckDB texts."""
from __future__ import annotations

from collections.abc import Callable
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flotsam.llm import bpe, exact_dedup, heap_kmeans, hnsw, kd_shards, language, licences, mixing, near_dup, quality, simhash, spelling, toxicity
from flotsam.llm.common import fold, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def register(oracle: str | None = None):
    def wrap(fn):
        QUERIES[fn.__name__] = fn
        if oracle is not None:
            ORACLES[fn.__name__] = oracle
        return fn
    return wrap


MIX_SQL = r"""
with d as (select doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) as size,
                  md5(coalesce(cast(doc_id as varchar), '-') || '|' || md5(coalesce(text, ''))) as k,
                  source is null as sn, coalesce(source, '') as ss from documents),
p as (select source, sum(size)::bigint as source_size, row_number() over (order by source nulls last) as rk from d group by source),
w as (select *, [5.0::double, 2.0::double, 1.0::double][((rk - 1) % 3 + 1)::int] as w, (3 * source_size)::double as cap from p),
l as (select *, (sum(source_size) over ()::double - coalesce(sum(cap) over (order by cap / w, rk rows between unbounded preceding and 1 preceding), 0))
             / (sum(w) over () - coalesce(sum(w) over (order by cap / w, rk rows between unbounded preceding and 1 preceding), 0)) as lv from w),
m as (select min(cap / w) as at from l where lv <= cap / w),
t as (select source, source_size, least(cap, coalesce((select first(lv order by cap / w, rk) from l where lv <= cap / w) * w, cap)) as target from l),
q as (select d.*, t.source_size, t.target, coalesce(sum(size) over (partition by d.source order by k rows between unbounded preceding and 1 preceding), 0) as ahead
      from d join t on d.source is not distinct from t.source),
c as (select q.*, r.r, (r.r * source_size + ahead + size)::double / target as fin from q, (select unnest([0, 1, 2]) as r) r where target > 0),
u as (select *, sum(size) over (order by fin, sn, ss, r, k rows between unbounded preceding and current row) as upto from c),
x as (select sn, ss, max(r) as r from u where upto <= (select sum(size) from d) group by sn, ss),
z as (select u.sn, u.ss, x.r, max(u.k) as cut from u join x on u.sn = x.sn and u.ss = x.ss and u.r = x.r
      where upto <= (select sum(size) from d) group by u.sn, u.ss, x.r)
select q.doc_id, q.size::bigint as size, q.source_size, q.target,
       (q.size * coalesce(z.r + case when q.k <= z.cut then 1 else 0 end, 0))::bigint as taken
from q left join z on q.sn = z.sn and q.ss = z.ss
"""


@register(MIX_SQL)
def op6_source_mix(spark, sf_dir):
    m = mixing.mix(table(spark, sf_dir, "documents"), weights=(5, 2, 1), share=1.0, repeats=3)
    return m.select("doc.doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))


@register()
def op9_kd_shards(spark, sf_dir):
    s = kd_shards.shard_documents(table(spark, sf_dir, "documents"), leaves=40)
    return s.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


DEDUP_SQL = r"""
with d as (select doc_id, length(coalesce(text, '')) as points, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') as norm from documents),
k as (select *, first_value(doc_id) over (partition by norm order by points desc, doc_id) as keep_id, count(*) over (partition by norm) as group_size from d)
select doc_id, keep_id, group_size, doc_id = keep_id as kept, sha256(norm) as text_sha256 from k
"""


@register(DEDUP_SQL)
def op10_exact_dedup(spark, sf_dir):
    return exact_dedup.mark_copies(table(spark, sf_dir, "documents"))


@register()
def op3_toxicity(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"), "toxic", fold(4) != 2)
    s = docs.select("doc_id", (fold(4) == 2).alias("held_out"), toxicity.score(model).alias("score"))
    return s.withColumn("predicted", (F.col("score") >= 0.3).cast("int"))


@register()
def op2_quality(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    model = quality.fit(docs, table(spark, sf_dir, "labels"), "quality", fold(5) != 0)
    s = docs.select("doc_id", (fold(5) == 0).alias("held_out"), quality.score(model).alias("score"))
    return s.withColumn("predicted", (F.col("score") >= 0.3).cast("int"))


@register()
def op4_language(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    model = language.fit(docs, fold(3) != 1)
    s = docs.select("doc_id", (fold(3) == 1).alias("held_out"), language.identify(docs, model).alias("said"))
    return s.select("doc_id", "held_out", "said.lang_pred", "said.score")


def public_tokenizer() -> str:
    """Content of the byte-level BPE file; it is read on the driver and sent to the tasks."""
    import public_tokenizers

    return Path(public_tokenizers.path("byte_bpe_50k.json")).read_text(encoding="utf-8")


@register()
def op1_bpe(spark, sf_dir):
    return bpe.digests(table(spark, sf_dir, "documents"), public_tokenizer())


@register()
def op5_hnsw(spark, sf_dir):
    return hnsw.nearest(table(spark, sf_dir, "embeddings"), F.coalesce(F.col("vec_id") % 100 == 0, F.lit(False)), k=10)


@register()
def op7_near_dup(spark, sf_dir):
    return near_dup.near_groups(table(spark, sf_dir, "documents")).select("doc_id", "class_id", "copy_id", "n_links")


#: a tree over documents: source / thousands / tens / file; every tenth document is its directory's licence file
PATH_SQL = ("concat(coalesce(source, '_'), '/d', cast(doc_id // 1000 as {s}), '/d', cast(doc_id % 1000 // 10 as {s}), '/', "
            "case when doc_id % 10 = 0 then 'LICENSE' else concat('doc', cast(doc_id as {s}), '.txt') end)")


def licence_sql() -> str:
    """The scan in SQL: every line's words against every template, without candidate filters."""
    words = licences.template_words()
    terms = ", ".join(f"('{name}', {i}, '{t}', {n})" for i, (name, c) in enumerate(words.items()) for t, n in sorted(c.items()))
    sep, path = licences.SEPARATOR, PATH_SQL.format(s="varchar")
    return rf"""
with files as (select doc_id, {path} as path, regexp_extract({path}, '^(.*)/[^/]*$', 1) as dir, coalesce(text, '') as text from documents),
tpl(licence, o, term, n) as (values {terms}),
bag as (select distinct doc_id, unnest(string_split_regex(lower(text), '{sep}')) as term from files),
cnt as (select count(*) as n from documents),
df as (select t.term, count(b.doc_id) as df from (select distinct term from tpl) t left join bag b on b.term = t.term group by t.term),
idf as (select term, ln((1 + (select n from cnt))::double / (1 + df)) + 1 as w from df),
own as (select licence, o, sqrt(sum((n * w) * (n * w))) as norm from tpl join idf using (term) group by licence, o),
lines as (select doc_id, unnest(string_split(text, chr(10))) as line, unnest(range(len(string_split(text, chr(10))))) as k from files),
lw as (select doc_id, k, unnest(string_split_regex(lower(line), '{sep}')) as term from lines),
tf as (select doc_id, k, term, count(*) as n from lw where term <> '' group by doc_id, k, term),
norms as (select doc_id, k, sqrt(sum(pow(n * coalesce(w, ln(1 + (select n from cnt)::double) + 1), 2))) as norm from tf left join idf using (term) group by doc_id, k),
dots as (select tf.doc_id, tf.k, tpl.licence, sum(tf.n * tpl.n * w * w) as dot from tf join tpl using (term) join idf using (term) group by tf.doc_id, tf.k, tpl.licence),
scores as (select d.doc_id, d.licence, own.o, round(dot / (norms.norm * own.norm), 6) as score from dots d join norms using (doc_id, k) join own using (licence)),
best as (select * from (select *, row_number() over (partition by doc_id order by score desc, o) as r from scores where score >= {licences.THRESHOLD}) where r = 1),
f as (select files.doc_id, path, dir, best.licence as own_licence, best.score as own_score, best.o from files left join best using (doc_id)),
granted as (select dir as from_dir, licence from (select dir, own_licence as licence, row_number() over (partition by dir order by own_score desc, o) as r
            from f where own_licence is not null and path like '%/LICENSE') where r = 1),
near as (select d.dir, arg_max(g.from_dir, length(g.from_dir)) as from_dir, arg_max(g.licence, length(g.from_dir)) as licence
         from (select distinct dir from f) d join granted g on d.dir = g.from_dir or starts_with(d.dir, g.from_dir || '/') group by d.dir)
select doc_id, path, own_licence, own_score, coalesce(own_licence, near.licence) as licence,
       case when own_licence is not null then 'header' when near.licence is not null then 'inherited' else 'none' end as origin,
       case when own_licence is null then near.from_dir end as from_dir
from f left join near using (dir)
"""


@register(licence_sql())
def op8_licences(spark, sf_dir):
    path = PATH_SQL.format(s="string").replace("doc_id // 1000", "doc_id div 1000").replace("doc_id % 1000 // 10", "doc_id % 1000 div 10")
    files = table(spark, sf_dir, "documents").select("doc_id", "text", F.expr(path).alias("path"))
    return licences.scan(files).select("file.doc_id", "file.path", "own_licence", "own_score", "licence", "origin", "from_dir")


@register()
def op11_simhash(spark, sf_dir):
    return simhash.near_groups(table(spark, sf_dir, "documents"))


def cluster_sql(k: int = 8, rounds: int = 10) -> str:
    """The rounds one after the other, every vector against every centroid."""
    each = "".join(f"""
d{r} as materialized (select v.rid, c.cl, sum((v.x - c.x) * (v.x - c.x)) as dist from v join k{r} c using (i) group by v.rid, c.cl),
a{r} as materialized (select rid, cl, dist from d{r} qualify row_number() over (partition by rid order by dist, cl) = 1),
n{r} as (select cl, i, sum(x) as s, count(*) as n from a{r} join v using (rid) group by cl, i),
k{r + 1} as materialized (select c.cl, c.i, case when n is null then c.x else ((s - ((s % n) + n) % n) // n)::bigint end as x from k{r} c left join n{r} using (cl, i)),"""
                   for r in range(rounds))
    return f"""
with e as materialized (select row_number() over () as rid, vec_id, embedding from embeddings where len(embedding) = 64),
c as materialized (select rid, unnest(range(64)) as i, unnest(embedding) as x from e),
v as materialized (select rid, i, floor(1024 * x::double)::bigint as x from c where rid in (select rid from c group by rid having count(x) = 64 and bool_and(isfinite(x)))),
w as (select rid, list(x order by i) as l from v group by rid),
f as (select sha256('3:' || coalesce(cast(vec_id as varchar), '')) as h, l from w join e using (rid) order by h, l limit {k}),
k0 as materialized (select cl, unnest(range(64)) as i, unnest(l) as x from (select row_number() over (order by h, l) - 1 as cl, l from f)),{each}
d as materialized (select v.rid, c.cl, sum((v.x - c.x) * (v.x - c.x)) as dist from v join k{rounds} c using (i) group by v.rid, c.cl),
a as (select rid, cl, dist from d qualify row_number() over (partition by rid order by dist, cl) = 1),
t as (select cl, sha256(string_agg(cast(x as varchar), ',' order by i)) as centroid_sha256 from k{rounds} group by cl)
select vec_id, cl::int as cluster, dist::bigint as distance, (sum(dist) over (partition by cl))::bigint as cluster_inertia, (sum(dist) over ())::bigint as inertia, centroid_sha256
from a join e using (rid) join t using (cl)
"""


@register(cluster_sql())
def op12_clusters(spark, sf_dir):
    return heap_kmeans.cluster(table(spark, sf_dir, "embeddings"), k=8, rounds=10)


@register()
def op13_spelling(spark, sf_dir):
    return spelling.variants(table(spark, sf_dir, "documents"))
