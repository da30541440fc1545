"""The registered queries of this subpackage, and SQL for those that SQL can express."""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest.llm import ball_tree, decontaminate, exact_dedup, html_extract, jaccard_join, lang_id, mixing, secret_scan, sentencepiece_bpe, token_counts, token_files, url_filter, word_runs
from palimpsest.llm.common import WORD, shared_path, stored

TOKENIZER, END_ID, PIECE_MODEL = "byte_bpe_50k.json", 2, "piece_bpe_32k.model"
RULES = [("allow", "org/"), ("block", "example.org/es/"), ("block", "example.org/en/1"), ("allow", "com/fr/"), ("block", "com/de/")]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_path(name: str = TOKENIZER) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op2_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, manifest = token_files.encode_to_files(spark, table(spark, sf_dir, "documents"), tokenizer_path(), end_id=END_ID)
    read = token_files.read_token_files(manifest)

    return read.select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document comes in with a provisional count from n_chars; then all counts are revised to those of the text;
    then the toxic documents go. The second batch is sent twice, as after a lost answer, and counts once."""
    docs = table(spark, sf_dir, "documents")
    rollup = token_counts.TokenCounts(spark, shared_path(spark, "token-counts"))
    was = docs.select("doc_id", "source", "lang", "text", F.coalesce("n_chars", F.lit(0)).cast("long").alias("was"))
    counts = stored(token_counts.counted(was, keep=["was"]), "counts")  # the texts are read once
    rollup.commit("1-inserts", token_counts.inserts(counts.withColumn("n_tokens", F.col("was"))))
    for _ in range(2):
        rollup.commit("2-revisions", token_counts.revisions(counts, F.col("was")))
    toxic = table(spark, sf_dir, "labels").where("toxic = 1").select("doc_id").distinct()
    rollup.commit("3-deletes", token_counts.deletes(counts.join(toxic, "doc_id", "left_semi")))
    return rollup.totals()


def op4_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.scan(table(spark, sf_dir, "documents")).select("doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_confirmed")


def op5_html_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.extract(table(spark, sf_dir, "pages"))


def op6_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.find_copies(table(spark, sf_dir, "documents"))


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    held_out = lang_id.held_out(F.col("doc_id"))
    model = lang_id.fit(docs.where(~held_out & F.col("doc_id").isNotNull()))
    return lang_id.identify(docs.select("doc_id", "text"), model).select("doc_id", held_out.alias("held_out"), "lang_pred", "score", "rejected")


def op8_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge(table(spark, sf_dir, "pages").select("page_id", "url"), RULES).drop("score")


def op9_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), any_case=True)
    return found.select("doc_id", "item_id", "covered", "exact")


def op10_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.join_components(table(spark, sf_dir, "documents"), jaccard_join.Likeness(size=4, percent=85))


def op11_ball_tree_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, centroids = ball_tree.cluster(table(spark, sf_dir, "embeddings"), k=16, rounds=3, dims=64, scale=64, seed=1)
    return ball_tree.with_inertia(rows, centroids)


def op12_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = tokenizer_path(PIECE_MODEL)
    back = sentencepiece_bpe.decode(sentencepiece_bpe.encode(table(spark, sf_dir, "documents"), path), path)
    ids = F.array_join(F.col("ids").cast("array<string>"), " ")
    return back.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(ids, 256).alias("ids_sha256"), F.sha2("text", 256).alias("decoded_sha256"))


def with_periods(docs: DataFrame) -> DataFrame:
    """(doc_id, text): documents whose h = crc32(doc_id) ends in 0 go on periodically from word a = g % n, g being h without that digit."""
    words = F.regexp_extract_all(F.col("text"), F.lit(WORD), F.lit(0))
    h = F.crc32(F.col("doc_id").cast("string"))
    n, g = F.size(words), F.floor(h / 10)
    a = (g % n).cast("int")
    p = F.lit(1) + F.floor((n - a) / (3 + g % 8)).cast("int")
    again = F.flatten(F.array_repeat(F.slice(words, a + 1, p), F.ceil((n - a) / p).cast("int")))
    text = F.array_join(F.slice(F.concat(F.slice(words, F.lit(1), a), again), F.lit(1), n), " ")
    return docs.select("doc_id", F.when((h % 10 == 0) & F.col("text").rlike(WORD), text).otherwise(F.col("text")).alias("text"))


def op13_word_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = word_runs.find(with_periods(table(spark, sf_dir, "documents")), min_length=6, min_exponent=4)
    lines = F.array_join(F.transform("runs", lambda r: F.concat_ws(",", r.start, r.length, r.period)), "\n", "")
    best = F.array_min(F.transform("runs", lambda r: F.struct((-r.length).alias("m"), r.start.alias("start"), r.period.alias("period"), r.length.alias("length"))))
    found = found.select("doc_id", "runs", "collapsed", best.alias("best"), lines.alias("lines"))
    more = [F.col(f"best.{c}").alias(c) for c in ("start", "length", "period")] + [F.floor(F.col("best.length") * 1000 / F.col("best.period")).alias("exponent_milli")]
    text = F.when(F.size("runs") > 0, F.concat("lines", F.lit("\n"))).otherwise("")
    return found.select("doc_id", F.size("runs").cast("long").alias("n_runs"), *more, F.sha2(text, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES = {f.__name__: f for f in (op1_mix_sources, op2_token_files, op3_token_counts, op4_secret_scan, op5_html_main_text, op6_exact_dedup, op7_language_id, op8_url_filter, op9_decontaminate, op10_jaccard_join, op11_ball_tree_clusters, op12_sentencepiece, op13_word_runs, pipeline)}

_WORDS = r"len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))"

_RULE = "case " + " ".join(f"when (host = '{h}' or suffix(host, '.{h}')) and starts_with(path, '/{p}') then '{h}/{p}'" for h, _, p in sorted((t.partition("/") for _, t in RULES), key=lambda x: -len("".join(x)))) + " end"
_SAID = "case rule " + " ".join(f"when '{t}' then '{v}'" for v, t in RULES) + " end"
_LEVELS = ",\n".join(
    f"""l{k} as (select n.gram, (n.a + {url_filter.PSEUDO}::double * {below("pa")}) / (c.ca + {url_filter.PSEUDO}::double) as pa, (n.r + {url_filter.PSEUDO}::double * {below("pr")}) / (c.cr + {url_filter.PSEUDO}::double) as pr
  from n join c on c.context = substr(n.gram, 1, length(n.gram) - 1){f" join l{k - 1} s on s.gram = substr(n.gram, 2)" if k else ""} where length(n.gram) = {k + 1})"""
    for k in range(url_filter.ORDER + 1)
    for below in [(lambda p, k=k: f"s.{p}" if k else f"(1.0::double / {url_filter.ALPHABET})")]
)

def _clusters(k: int = 16, rounds: int = 3, dims: int = 64, scale: int = 64, seed: int = 1) -> str:
    """Plain k-means: each vector against each centroid, in each round."""
    steps = []
    for j in range(rounds + 1):
        steps.append(f"""a{j} as (select rid, vec_id, x, c, d from (select v.rid, v.vec_id, v.x, m.c, cast(list_sum(list_transform(range(1, {dims} + 1), lambda i: (v.x[i] - m.x[i]) * (v.x[i] - m.x[i]))) as bigint) as d from v, c{j} m) qualify row_number() over (partition by rid order by d, c) = 1)""")
        if j < rounds:
            steps.append(f"""c{j + 1} as (select m.c, coalesce(n.x, m.x) as x from c{j} m left join (select c, list(cast((s - ((s % n) + n) % n) // n as bigint) order by i) as x from (select c, i, sum(x[i]) as s, count(*) as n from a{j}, (select unnest(range(1, {dims} + 1)) as i) group by c, i) group by c) n using (c))""")
    steps = ",\n".join(steps)
    return f"""
with v as (select row_number() over () as rid, vec_id, list_transform(embedding, lambda e: cast(floor({scale} * cast(e as double)) as bigint)) as x from embeddings
  where len(embedding) = {dims} and len(list_filter(embedding, lambda e: e is not null and isfinite(e))) = {dims}),
c0 as (select row_number() over (order by sha256('{seed}:' || vec_id) nulls last, x) - 1 as c, x from v qualify c < {k}),
{steps}
select vec_id, cast(c as integer) as cluster, d as distance, cast(sum(d) over (partition by c) as bigint) as cluster_inertia, cast(sum(d) over () as bigint) as inertia,
  sha256(array_to_string(m.x, ',')) as centroid_sha256 from (select vec_id, c, d from a{rounds}) join c{rounds} m using (c)"""


SQL = {
    "op11_ball_tree_clusters": _clusters(),
    "op1_mix_sources": rf"""
with d as (
  select doc_id, source, cast({_WORDS} as bigint) as size,
    cast('0x' || substr(md5(coalesce(cast(doc_id as varchar), text, '')), 1, 15) as bigint) as h
  from documents),
s as (select source, cast(sum(size) as bigint) as source_size from d group by source),
r as (select *, cast((row_number() over (order by source asc nulls last) - 1) % 3 + 1 as double) as weight, source_size * 3.0::double as cap from s),
o as (select *, cap / weight as stops from r),
l as (select *, (1.0::double * sum(source_size) over () - coalesce(sum(cap) over (order by stops, source asc nulls last rows between unbounded preceding and 1 preceding), 0))
  / (sum(weight) over () - coalesce(sum(weight) over (order by stops, source asc nulls last rows between unbounded preceding and 1 preceding), 0)) as level from o),
f as (select level from l where level <= stops order by stops, source asc nulls last limit 1),
p as (select source, source_size, least(cap, (select level from f) * weight) as target from l),
q as (select *, case when source_size > 0 then floor(target / source_size) else 0 end as whole from p),
w as (select d.doc_id, d.size, d.h, q.source_size, q.target, cast(q.whole as bigint) as whole, q.target - q.whole * q.source_size as rest,
    sum(d.size) over (partition by q.source order by d.h range between unbounded preceding and current row) as upto,
    sum(d.size) over (partition by q.source, d.h) as here
  from d join q on d.source is not distinct from q.source)
select doc_id, size, source_size, target,
  cast(size * (whole + case when rest > 0 and (upto <= rest or (upto - here < rest and upto - rest <= rest - (upto - here))) then 1 else 0 end) as bigint) as taken
from w""",
    "op3_token_counts": rf"""
with kept as (select * from documents d where not exists (select 1 from labels l where l.doc_id = d.doc_id and l.toxic = 1))
select source, lang, 'words-1' as tokenizer, count(*) as n_docs, cast(sum({_WORDS}) as bigint) as n_tokens from kept group by source, lang
union all
select source, lang, 'utf8-bytes-1', count(*), cast(sum(strlen(coalesce(text, ''))) as bigint) from kept group by source, lang""",
    "op6_exact_dedup": """
select doc_id, max(doc_id) over w as keep_id, count(*) over w as group_size, doc_id is not distinct from max(doc_id) over w as kept, sha256(coalesce(text, '')) as text_sha256
from documents window w as (partition by coalesce(text, ''))""",
    "op8_url_filter": rf"""
with h as (select page_id, coalesce(url, '') as url, translate(coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)', 1), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as host, coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)', 2), '') as path from pages),
d as (select *, {_RULE} as rule from h), rows_ as (select *, {_SAID} as said from d),
labelled as (select url, said = 'allow' as accepted, cast('0x' || substr(md5(url), 1, 8) as bigint) % 5 = 0 as unseen from rows_ where said is not null),
seen as (select distinct url, chr(2) || url || chr(3) as u from rows_), places as (select url, u, unnest(range(2, length(u) + 1)) as pos from seen),
grams as (select url, pos, substr(u, pos - k, k + 1) as gram from places, (select unnest(range(0, {url_filter.ORDER + 1})) as k) where pos > k),
n as (select gram, sum(case when accepted then 1 else 0 end) as a, sum(case when accepted then 0 else 1 end) as r from labelled join grams using (url) where not unseen group by gram),
c as (select substr(gram, 1, length(gram) - 1) as context, sum(a) as ca, sum(r) as cr from n group by 1),
{_LEVELS},
model as (select gram, cast(floor((ln(pa) - ln(pr)) * 1000000 + 0.5) as bigint) as micro from ({" union all ".join(f"select * from l{k}" for k in range(url_filter.ORDER + 1))}) where exists (select 1 from c where context = '' and ca > 0 and cr > 0)),
best as (select url, pos, coalesce(arg_max(micro, length(gram)) filter (micro is not null), 0) as micro from grams left join model using (gram) group by url, pos),
scored as (select url, cast(floor(sum(micro)::double / count(*)) as bigint) as score from best group by url),
bins as (select greatest(-{url_filter.BINS}, least({url_filter.BINS}, cast(floor(score / {url_filter.BIN}.0) as bigint))) as bin, sum(case when accepted then 1 else 0 end) as a, sum(case when accepted then 0 else 1 end) as r from (select distinct url, accepted from labelled where unseen) join scored using (url) group by 1),
errors as (select bin, coalesce(sum(a) over w, 0) * sum(r) over () + (sum(r) over () - coalesce(sum(r) over w, 0)) * sum(a) over () as err, sum(a) over () as all_a, sum(r) over () as all_r from bins window w as (order by bin rows between unbounded preceding and 1 preceding)),
edge as (select coalesce((select bin * {url_filter.BIN} from errors where all_a > 0 and all_r > 0 order by err, abs(bin), bin limit 1), 0) as threshold)
select page_id, host, path, rule, coalesce(said, case when score >= threshold then 'allow' else 'block' end) as verdict from rows_ join scored using (url), edge""",
    "op10_jaccard_join": r"""
with recursive w as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') as ws from documents),
s as (select distinct doc_id, unnest(case when len(ws) >= 4 then list_transform(range(1, len(ws) - 2), lambda i: array_to_string(ws[i : i + 3], ' ')) when len(ws) > 0 then [array_to_string(ws, ' ')] else [] end) as shingle from w),
n as (select doc_id, count(*) as n from s group by doc_id),
p as (select a.doc_id as x, b.doc_id as y, count(*) as c from s a join s b on a.shingle = b.shingle and a.doc_id < b.doc_id group by 1, 2),
l as (select x, y from p join n a on a.doc_id = x join n b on b.doc_id = y where 100 * c >= 85 * (a.n + b.n - c)),
e as (select x as a, y as b from l union all select y, x from l),
reach as (select doc_id, doc_id as r from documents union select reach.doc_id, e.b from reach join e on reach.r = e.a)
select d.doc_id, coalesce(n.n, 0) as n_shingles, (select min(r) from reach where reach.doc_id = d.doc_id) as component_id from documents d left join n on n.doc_id = d.doc_id""",
}
