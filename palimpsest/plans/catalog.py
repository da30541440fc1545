"""The registered queries, and DuckDB SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from palimpsest.functions.columns import key, millis, rounded
from palimpsest.operators import buckets, classify, comments, containment, flow, integrity, kinds, positions, rules, scores, sessions, snapshots, structure, tamper, targets, versions, windows
from palimpsest.sources import adapters, docx, docx_edit, nodes
from palimpsest.sources.adapters import table
from palimpsest.sources.scratch import stored

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}

_REV = """rev as (select cast(floor(user_id / 3) as bigint) as doc_id, event_id as seq, cast(event_id as varchar) as rev_id, cast(user_id as varchar) as author, epoch_us(ts) // 1000 as ms,
  case when event_type = 'error' then 'del' else 'ins' end as type, cast(ceil(value) as bigint) as chars from events)"""
_DAY = """day as (select * exclude (ms), epoch_ms(date_trunc('day', make_timestamp(ms * 1000))) as ms from rev)"""


def query(sql: str | None = None) -> Callable:
    def register(f: Callable) -> Callable:
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return register


def _rev(spark: SparkSession, sf_dir: str) -> DataFrame:
    return adapters.revisions(table(spark, sf_dir, "events"))


def _ms(df: DataFrame, *names: str) -> DataFrame:
    return df.withColumns({n: millis(F.col(n)) for n in names})


@query(f"""with {_REV} select doc_id, cast(sum(case when type = 'ins' then chars else 0 end) as bigint) as inserted, cast(sum(case when type = 'del' then chars else 0 end) as bigint) as deleted,
  count(*) filter (type = 'ins') as insertions, count(*) filter (type = 'del') as deletions, min(ms) as first, max(ms) as last,
  cast(greatest(0, 10000 - sum(case when type = 'ins' then chars else 0 end) + sum(case when type = 'del' then chars else 0 end)) as bigint) as baseline from rev group by doc_id""")
def revision_totals(spark, sf_dir):
    return _ms(sessions.totals(_rev(spark, sf_dir), F.lit(10_000)), "first", "last")


def _sessions_sql(hours: float) -> str:
    return f"""{_REV}, lagged as (select *, ms - lag(ms) over (partition by doc_id order by ms, seq) as gap from rev),
  sess as (select *, cast(sum(case when gap > {int(hours * 3_600_000)} then 1 else 0 end) over (partition by doc_id order by ms, seq rows unbounded preceding) as integer) as session,
    case when gap > {int(hours * 3_600_000)} then gap / 3600000.0::double end as gap_before_hours from lagged)"""


def _gap_sessions(hours):
    return lambda spark, sf_dir: sessions.with_session(_rev(spark, sf_dir), hours).select("doc_id", "seq", "session", "gap_before_hours")


for _name, _hours in (("gap_sessions_1h", 1), ("gap_sessions_12h", 12)):
    QUERIES[_name] = _gap_sessions(_hours)
    SQL[_name] = f"with {_sessions_sql(_hours)} select doc_id, seq, session, gap_before_hours from sess"


@query(f"""with {_sessions_sql(4)} select doc_id, session, min(ms) as start, max(ms) as "end", count(*) as events, cast(sum(case when type = 'ins' then chars else 0 end) as bigint) as inserted,
  cast(sum(case when type = 'del' then chars else 0 end) as bigint) as deleted, max(gap_before_hours) as gap_before_hours from sess group by doc_id, session""")
def session_summary(spark, sf_dir):
    return _ms(sessions.summaries(sessions.with_session(_rev(spark, sf_dir), 4)), "start", "end")


_KINDS = f"""{_REV}, {_DAY}, kinded as (select *, case when type <> 'ins' then null when sum(case when type = 'ins' then chars else 0 end) over (partition by doc_id, author, ms) >= 150 then 'bulk' else 'fine' end as kind from day)"""


def _kinded(spark, sf_dir):
    return kinds.with_kinds(adapters.by_day(_rev(spark, sf_dir)).withColumn("moved", F.lit(False)))


@query(f"with {_KINDS} select doc_id, seq, kind from kinded")
def bulk_kinds(spark, sf_dir):
    return _kinded(spark, sf_dir).select("doc_id", "seq", "kind")


@query(f"with {_KINDS} select author, count(*) filter (kind = 'bulk') as bulk, count(*) filter (kind = 'fine') as fine, cast(sum(case when kind = 'bulk' then chars else 0 end) as bigint) as bulk_chars from kinded group by author")
def bulk_by_author(spark, sf_dir):
    rows = _kinded(spark, sf_dir)
    return rows.groupBy("author").agg(F.count_if(F.col("kind") == "bulk").alias("bulk"), F.count_if(F.col("kind") == "fine").alias("fine"), F.sum(F.when(F.col("kind") == "bulk", F.col("chars")).otherwise(0)).alias("bulk_chars"))


def _buckets_sql(width: str) -> str:
    return f"""{_REV}, k as (select *, case when type = 'ins' and chars >= 100 then 'bulk' when type = 'ins' then 'fine' end as kind from rev),
  span as (select doc_id, min(ms) as t0, max(ms) as t1, greatest(1.0::double, (max(ms) - min(ms)) / 1000.0::double) as span from k group by doc_id),
  wide as (select *, cast({width} * 1000 as bigint) as w from span),
  marked as (select k.*, t0, w, cast((ms - t0) // w as integer) as bucket from k join wide using (doc_id)),
  sums as (select doc_id, bucket, cast(sum(case when type = 'ins' then chars else 0 end) as bigint) as added, cast(sum(case when kind = 'fine' then chars else 0 end) as bigint) as fine, cast(sum(case when kind = 'bulk' then chars else 0 end) as bigint) as bulk,
    cast(sum(case when type = 'del' then chars else 0 end) as bigint) as deleted from marked group by doc_id, bucket),
  grid as (select doc_id, t0, w, cast(unnest(range(0, (t1 - t0) // w + 1)) as integer) as bucket from wide),
  filled as (select g.doc_id, g.bucket, g.t0 + g.bucket * g.w as start, g.w / 1000.0::double as width_seconds, coalesce(added, 0) as added, coalesce(fine, 0) as fine, coalesce(bulk, 0) as bulk, coalesce(deleted, 0) as deleted from grid g left join sums s using (doc_id, bucket)),
  running as (select *, cast(sum(added - deleted) over (partition by doc_id order by bucket rows unbounded preceding) as bigint) as total_at_end from filled)"""


_AUTO = "(case " + " ".join(f"when {w} >= span / 40 then {w}" for w in buckets.AUTO[:-1]) + f" else {buckets.AUTO[-1]} end)"
_BUCKET = ["doc_id", "bucket", "start", "width_seconds", "added", "fine", "bulk", "deleted", "total_at_end"]


def _bucket_rows(spark, sf_dir, width):
    rev = _rev(spark, sf_dir).withColumn("kind", F.when((F.col("type") == "ins") & (F.col("chars") >= 100), "bulk").when(F.col("type") == "ins", "fine"))
    return buckets.buckets(rev, width)


@query(f"with {_buckets_sql('86400')} select {', '.join(_BUCKET)} from running")
def activity_buckets_day(spark, sf_dir):
    return _ms(_bucket_rows(spark, sf_dir, "day").select(*_BUCKET), "start")


@query(f"with {_buckets_sql(_AUTO)} select {', '.join(_BUCKET)} from running")
def activity_buckets_auto(spark, sf_dir):
    return _ms(_bucket_rows(spark, sf_dir, "auto").select(*_BUCKET), "start")


@query(f"with {_buckets_sql('86400')} select doc_id, bucket, max(greatest(added, deleted)) over (partition by doc_id) as max_bar, max(total_at_end) over (partition by doc_id) as max_total from running")
def bucket_scale(spark, sf_dir):
    return buckets.scale(_bucket_rows(spark, sf_dir, "day")).select("doc_id", "bucket", "max_bar", "max_total")


_SCORED = f"""{_REV}, ins as (select *, row_number() over w - 1 as index, greatest(1.0::double, (ms - lag(ms) over w) / 1000.0::double) as g, lag(ms) over w as before from rev where type = 'ins' window w as (partition by doc_id order by ms, seq)),
  timed as (select *, case when before is null then null else g end as dt_seconds from ins),
  parts as (select *, case when chars >= 20 then least(100.0::double, greatest(0.0::double, (chars - 20.0::double) / 280.0::double * 100)) else 0.0::double end as burst,
    case when chars >= 20 and dt_seconds is not null then least(100.0::double, greatest(0.0::double, (chars / dt_seconds - 8.0::double) / 32.0::double * 100)) else 0.0::double end as rate from timed),
  scored as (select *, floor(burst * 10 + 0.5) / 10 as burst_score, floor(rate * 10 + 0.5) / 10 as rate_score, floor(greatest(burst, rate) * 10 + 0.5) / 10 as event_score from parts)"""


@query(f"with {_SCORED} select doc_id, seq, cast(index as integer) as index, dt_seconds, burst_score, rate_score, event_score from scored")
def event_scores(spark, sf_dir):
    return scores.event_scores(_rev(spark, sf_dir)).select("doc_id", "seq", "index", "dt_seconds", "burst_score", "rate_score", "event_score")


@query(f"""with {_SCORED}, d as (select doc_id, max(event_score) as m, sum(cast(event_score * 10 as bigint) * chars) / 10.0::double / greatest(1, sum(chars)) as a from scored group by doc_id),
  t as (select doc_id, cast(sum(case when type = 'ins' then chars else 0 end) as bigint) as inserted, cast(sum(case when type = 'del' then chars else 0 end) as bigint) as deleted, count(*) filter (type = 'ins') as insertions from rev group by doc_id),
  s as (select t.*, cast(coalesce(floor(least(100, greatest(0, 0.6::double * m + 0.4::double * a)) + 0.5), 0) as bigint) as score from t left join d using (doc_id))
  select doc_id, score, case when score >= 75 then 'very_high' when score >= 45 then 'high' when score >= 20 then 'medium' else 'low' end as risk, inserted, deleted, insertions, insertions < 5 as few_events from s""")
def doc_scores(spark, sf_dir):
    return scores.document_scores(_rev(spark, sf_dir)).select("doc_id", "score", "risk", "inserted", "deleted", "insertions", "few_events")


@query(f"with {_SCORED}, r as (select *, row_number() over (partition by doc_id order by event_score desc, index) as rank from scored) select doc_id, seq, cast(rank as integer) as rank, event_score from r where rank <= 5 and event_score > 0")
def top_suspicious(spark, sf_dir):
    return scores.top_events(scores.event_scores(_rev(spark, sf_dir))).select("doc_id", "seq", "rank", "event_score")


_PLACED = f"""{_REV}, {_DAY}, placed as (select *, seq * 37 % 5000 as lo, seq * 37 % 5000 + case when type = 'ins' then chars else 0 end as hi, (seq * 37 % 5000) // 250 as para from day)"""
_WINDOWS = f"""{_PLACED}, ins as (select * from placed where type = 'ins' and chars > 0),
  win as (select doc_id, author, ms, min(lo) as lo, max(hi) as hi, min_by(para, (lo, para)) as first_para, max_by(para, (hi, para)) as last_para, cast(sum(chars) as bigint) as inserted_chars, max(chars) as max_single_insert, count(*) as insert_count, count(distinct para) as para_count,
    list(rev_id order by ms, seq) as event_ids from ins group by doc_id, author, ms),
  near as (select w.doc_id, w.author, w.ms, cast(sum(case when p.ms > w.ms then p.chars else 0 end) as bigint) as post, cast(sum(case when p.type = 'del' and p.ms = w.ms then p.chars else 0 end) as bigint) as pre
    from win w join placed p on p.doc_id = w.doc_id and p.hi >= w.lo and p.lo <= w.hi and not (p.type = 'ins' and p.author = w.author and p.ms = w.ms) group by w.doc_id, w.author, w.ms),
  feat as (select win.*, coalesce(post, 0) / inserted_chars::double as post_edit_ratio, coalesce(pre, 0) as preceding_deleted_chars, coalesce(pre, 0) > 0 as preceded_by_deletion, 60.0::double as duration_sec, inserted_chars / 60.0::double as cps,
    hi - lo as span_chars, last_para - first_para + 1 as span_paras from win left join near using (doc_id, author, ms))"""


def _windows(spark, sf_dir, options=windows.WindowOptions(by_author=True)):
    return windows.windows(adapters.placed(adapters.by_day(_rev(spark, sf_dir))), options)


@query(f"with {_WINDOWS} select doc_id, author, ms as start, inserted_chars, insert_count, array_to_string(event_ids, ',') as event_ids from feat")
def insertion_windows_default(spark, sf_dir):
    rows = _windows(spark, sf_dir)
    return rows.select("doc_id", F.get("authors", F.lit(0)).alias("author"), millis(F.col("start")).alias("start"), "inserted_chars", "insert_count", F.array_join("event_ids", ",").alias("event_ids"))


@query(f"""with {_WINDOWS} select doc_id, author, ms as start, inserted_chars, duration_sec, floor(cps * 1000000 + 0.5) / 1000000 as cps, span_chars, span_paras, max_single_insert, para_count, floor(post_edit_ratio * 1000000 + 0.5) / 1000000 as post_edit_ratio,
  preceding_deleted_chars, preceded_by_deletion, insert_count from feat""")
def window_features(spark, sf_dir):
    rows = _windows(spark, sf_dir)
    longs = {c: F.col(c).cast("long") for c in ("span_chars", "span_paras", "para_count")}
    return rows.withColumns(longs).select("doc_id", F.get("authors", F.lit(0)).alias("author"), millis(F.col("start")).alias("start"), "inserted_chars", "duration_sec", rounded(F.col("cps"), 6).alias("cps"), "span_chars", "span_paras", "max_single_insert", "para_count", rounded(F.col("post_edit_ratio"), 6).alias("post_edit_ratio"), "preceding_deleted_chars", "preceded_by_deletion", "insert_count")


RULES = {"ruleSet": "catalog", "window": {"seconds": 0, "byAuthor": True}, "levels": [
    {"id": "paste", "color": "#c00", "when": {"all": [{"insertedChars": {"gte": 200}}, {"not": {"precededByDeletion": True}}]}},
    {"id": "replace", "color": "#0a0", "when": {"any": [{"precedingDeletedChars": {"gt": 50}}, {"insertCount": {"gte": 3}, "cps": {"lt": 5}}]}},
    {"id": "small", "color": "#00c", "when": {"maxSingleInsert": {"lte": 30}}},
]}
_LEVEL = "case when inserted_chars >= 200 and not preceded_by_deletion then 'paste' when preceding_deleted_chars > 50 or (insert_count >= 3 and cps < 5) then 'replace' when max_single_insert <= 30 then 'small' end"


@query(f"with {_WINDOWS} select doc_id, author, ms as start, {_LEVEL} as level, 'level:' || ({_LEVEL}) as category from feat")
def rule_levels(spark, sf_dir):
    rows = rules.with_level(_windows(spark, sf_dir), rules.rule_set(RULES))
    return rows.select("doc_id", F.get("authors", F.lit(0)).alias("author"), millis(F.col("start")).alias("start"), "level", "category")


@query(f"""with {_WINDOWS}, lev as (select *, {_LEVEL} as level from feat), exploded as (select doc_id, unnest(event_ids) as rev_id, level from lev where level is not null)
  select d.doc_id, d.seq, case when d.type <> 'ins' then null when level is not null then 'bulk' else 'fine' end as kind, level, 'level:' || level as category from day d left join exploded e on d.doc_id = e.doc_id and d.rev_id = e.rev_id""")
def highlight_merge(spark, sf_dir):
    events = adapters.placed(adapters.by_day(_rev(spark, sf_dir)))
    result = classify.run(classify.built_in(rules.rule_set(RULES)), classify.Context(events))
    return classify.apply(events, result.winners).select("doc_id", "seq", "kind", "level", "category")


@query(f"""with {_WINDOWS}, lev as (select *, {_LEVEL} as level from feat), e as (select doc_id, unnest(event_ids) as rev_id, level from lev where level is not null)
  select d.doc_id, d.seq, case when d.type <> 'ins' then null when level is not null then 'bulk' else 'fine' end as kind, level from day d left join e on d.doc_id = e.doc_id and d.rev_id = e.rev_id""")
def levels_by_insertion(spark, sf_dir):
    events = adapters.by_day(_rev(spark, sf_dir)).withColumn("moved", F.lit(False))
    levels = rules.levels_of_insertions(rules.with_level(_windows(spark, sf_dir), rules.rule_set(RULES)))
    return kinds.with_levels(events, levels).select("doc_id", "seq", "kind", "level")


def _windows_sql(who: str) -> str:
    """The insertions in order of time, numbered by document (and author)."""
    return f"""with recursive {_REV}, p as (select r.doc_id, {who} as who, epoch_us(e.ts) as us, r.ms, r.seq, r.chars, r.seq * 37 % 5000 as lo, r.seq * 37 % 5000 + r.chars as hi, row_number() over (partition by r.doc_id, {who} order by r.ms, r.seq) as r
    from rev r join events e on e.event_id = r.seq where r.type = 'ins' and r.chars > 0)"""


_WINDOW_ROWS = """select doc_id, cast(row_number() over (partition by doc_id order by start, lo, who, k) - 1 as integer) as index, start // 1000 as start, inserted_chars, insert_count"""


@query(f"""{_windows_sql("''")}, w as (select doc_id, who, r, 1 as k, [struct_pack(at := ms, lo := lo, hi := hi)] as open from p where r = 1
  union all select doc_id, who, r, coalesce(hit, len(open) + 1), case when hit is null then list_append(open, struct_pack(at := ms, lo := lo, hi := hi)) else list_transform(open, lambda x, i: case when i = hit then struct_pack(at := x.at, lo := least(x.lo, lo), hi := greatest(x.hi, hi)) else x end) end
    from (select p.*, open, list_position(list_transform(open, lambda x: p.ms - x.at <= 1800000 and greatest(0, p.lo - x.hi, x.lo - p.hi) <= 800), true) as hit from w join p on p.doc_id = w.doc_id and p.who = w.who and p.r = w.r + 1)),
  g as (select p.doc_id, p.who, k, min(us) as start, min(lo) as lo, max(hi) as hi, cast(sum(chars) as bigint) as inserted_chars, count(*) as insert_count from p join w using (doc_id, who, r) group by 1, 2, 3)
  {_WINDOW_ROWS}, cast(hi - lo as integer) as span_chars from g""")
def windows_half_hour(spark, sf_dir):
    """Windows of half an hour within 800 characters: the rows of a document in order of time, each to the first open window near it."""
    rows = windows.windows(adapters.placed(_rev(spark, sf_dir)), windows.WindowOptions(seconds=1800, chars=800))
    return rows.select("doc_id", "index", millis(F.col("start")).alias("start"), "inserted_chars", "insert_count", "span_chars")


@query(f"""{_windows_sql("r.author")}, w as (select doc_id, who, r, ms as since, 0 as k from p where r = 1
  union all select p.doc_id, p.who, p.r, case when p.ms - since > 21600000 then p.ms else since end, k + case when p.ms - since > 21600000 then 1 else 0 end from w join p on p.doc_id = w.doc_id and p.who = w.who and p.r = w.r + 1),
  g as (select p.doc_id, p.who, k, min(us) as start, min(lo) as lo, cast(sum(chars) as bigint) as inserted_chars, count(*) as insert_count from p join w using (doc_id, who, r) group by 1, 2, 3)
  {_WINDOW_ROWS} from g""")
def windows_by_time(spark, sf_dir):
    """Windows of six hours by author, without bounds on the place."""
    rows = windows.windows(adapters.placed(_rev(spark, sf_dir)), windows.WindowOptions(seconds=21_600, by_author=True))
    return rows.select("doc_id", "index", millis(F.col("start")).alias("start"), "inserted_chars", "insert_count")


_REPEATED = f"""{_REV}, c as (select *, seq % 97 as k, seq % 5 = 0 as move, cast(seq % 40 as integer) as para_index from rev)"""


@query(f"with {_REPEATED} select doc_id, seq from c i where type = 'ins' and not move and chars > 0 and not exists (select 1 from c d where d.doc_id = i.doc_id and d.type = 'del' and not d.move and d.k = i.k)")
def window_candidates(spark, sf_dir):
    """Insertions that windows are made of, where texts repeat: those whose text was deleted elsewhere in the document are out."""
    rows = adapters.placed(_rev(spark, sf_dir)).withColumns({"text": adapters.repeated_text(F.col("seq")), "move": F.col("seq") % 5 == 0})
    return windows.candidates(rows).select("doc_id", "seq")


_WS = r"[\s\x{0B}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}]+"


@query(rf"""with t as (select conv_id as doc_id, turn, role, regexp_replace(coalesce(text, ''), '{_WS}', '', 'g') as plain from conversations),
  corpus as (select doc_id, string_agg(plain, '' order by turn) as corpus from t where role = 'user' group by doc_id)
  select t.doc_id, turn, length(plain) >= 20 and coalesce(contains(corpus, plain), false) as moved from t left join corpus using (doc_id)""")
def relocation_matches(spark, sf_dir):
    """Whether what a turn says is among what users said in the conversation, white space aside."""
    rows = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("doc_id"), "turn", "role", "text")
    return containment.with_contained(rows, rows.where("role = 'user'"), "moved", ["doc_id"], ["turn"]).select("doc_id", "turn", "moved")


_SUBS = f"""{_REV}, weekly as (select *, cast((ms - 1704067200000) // 604800000 as integer) as week from rev),
  sub as (select doc_id as key, week + d as n, seq, type, author, ms, cast(chars as varchar) as text, chars from weekly, (select unnest([0, 1]) as d) where seq % 11 <> d * 3),
  keyed as (select *, type || '|' || author || '|' || ms || '|' || text as event_key from sub), numbered as (select *, row_number() over (partition by key, n, event_key order by seq) as k from keyed),
  marked as (select *, n = min(n) over (partition by key, event_key, k) as is_new from numbered),
  per as (select key, n, count(*) filter (is_new) as new_events, count(*) filter (not is_new) as carried_events, cast(coalesce(sum(chars) filter (is_new and type = 'ins'), 0) as bigint) as inserted, cast(coalesce(sum(chars) filter (is_new and type = 'del'), 0) as bigint) as deleted,
    min(ms) filter (is_new) as f, max(ms) filter (is_new) as l from marked group by key, n),
  before as (select *, max(l) over (partition by key order by n rows between unbounded preceding and 1 preceding) as previous_last_ms from per),
  late as (select m.key, m.n, count(*) as c from marked m join before b on m.key = b.key and m.n = b.n where is_new and ms < previous_last_ms - 60000 group by m.key, m.n)"""


def _submissions(spark, sf_dir):
    """Each week's changes are in that week's submission and the next one's, but for some that are lost in one of them."""
    rev = _rev(spark, sf_dir).withColumn("week", F.floor((millis(F.col("ts")) - 1_704_067_200_000) / 604_800_000).cast("int"))
    rows = rev.withColumn("d", F.explode(F.array(F.lit(0), F.lit(1)))).where(F.col("seq") % 11 != F.col("d") * 3)
    return rows.select(F.col("doc_id").alias("key"), (F.col("week") + F.col("d")).alias("n"), "seq", "type", "author", "ts", F.col("chars").cast("string").alias("text"), "chars")


@query(f"with {_SUBS} select b.key, b.n, new_events, carried_events, inserted, deleted, coalesce(previous_last_ms, -1) as previous_last_ms, coalesce(c, 0) as dated_before_previous from before b left join late using (key, n)")
def snapshot_delta(spark, sf_dir):
    return snapshots.deltas(_submissions(spark, sf_dir)).select("key", "n", "new_events", "carried_events", "inserted", "deleted", F.coalesce("previous_last_ms", F.lit(-1)).alias("previous_last_ms"), "dated_before_previous")


@query(f"with {_SUBS} select key, n, f as start, l as \"end\", case when lag(l) over (partition by key order by n) is not null then greatest(0.0::double, (f - lag(l) over (partition by key order by n)) / 3600000.0::double) end as gap_before_hours from before where new_events > 0")
def snapshot_sessions(spark, sf_dir):
    return _ms(snapshots.sessions(snapshots.deltas(_submissions(spark, sf_dir))).select("key", "n", "start", "end", "gap_before_hours"), "start", "end")


@query(f"with {_SUBS} select b.key, b.n, 'datedBeforePrevious' as evidence, cast(c as varchar) as changes from before b join late using (key, n)")
def snapshot_late(spark, sf_dir):
    return snapshots.late_evidence(snapshots.deltas(_submissions(spark, sf_dir))).select("key", "n", "evidence", F.col("details")["changes"].alias("changes"))


@query("""with f as (select source as key, doc_id as arrived, sha256(coalesce(lang, '')) as sha256 from documents), l as (select *, lag(sha256) over (partition by key order by arrived) as b from f)
  select key, arrived, cast(row_number() over (partition by key order by arrived) as integer) as n from l where b is null or b <> sha256""")
def archive_changes(spark, sf_dir):
    """Of a source's documents in order, those that differ in language from the one before: what an archive of it would keep."""
    rows = table(spark, sf_dir, "documents").select(F.col("source").alias("key"), F.col("doc_id").alias("arrived"), F.sha2(F.coalesce("lang", F.lit("")), 256).alias("sha256"), F.col("doc_id").cast("string").alias("path"))
    return snapshots.changed_files(rows).select("key", "arrived", "n")


@query("""with p as (select conv_id as doc_id, turn, coalesce(text, '') as text from conversations), u as (select *, length(text) + length(regexp_replace(text, '[^\\x{10000}-\\x{10FFFF}]', '', 'g')) as n from p)
  select doc_id, cast(turn as integer) as para_index, cast(coalesce(sum(n + 1) over (partition by doc_id order by turn rows between unbounded preceding and 1 preceding), 0) as bigint) as para_start, cast(n as bigint) as chars from u""")
def doc_offsets(spark, sf_dir):
    paras = adapters.conversation_paragraphs(table(spark, sf_dir, "conversations"))
    none = F.lit(None).cast("struct<id:string,ts:timestamp,author:string,move:boolean,move_name:string>")
    rows = paras.select("doc_id", "para_index", F.lit(0).alias("seg_index"), F.lit(False).alias("mark"), "text", none.alias("ins"), none.alias("del"))
    return positions.placed(rows).select("doc_id", "para_index", F.col("para_start").cast("long").alias("para_start"), F.col("para_chars").cast("long").alias("chars"))


_TURNS = """t as (select conv_id as doc_id, turn, coalesce(text, '') as text, role = 'assistant' as said, 1704067200000 + turn * 60000 as made, 1704067200000 + turn * 60000 + 3600000 as gone from conversations),
  points as (select unnest([1704067200000 + 120000, 1704067200000 + 3600000 + 61000]) as at_ms)"""


def _two_times(spark, sf_dir):
    docs = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("doc_id")).distinct()
    return docs.withColumn("at_ms", F.explode(F.array(F.lit(1_704_067_320_000), F.lit(1_704_070_861_000))))


@query(f"with {_TURNS} select doc_id, at_ms, string_agg(text, chr(10) order by turn) as text from t, points where true group by doc_id, at_ms")
def text_at_any(spark, sf_dir):
    """Paragraphs whose marks aren't tracked always exist, so each has its line."""
    segs, paras = adapters.conversation_segments(table(spark, sf_dir, "conversations"))
    rows = positions.text_at(segs.withColumns({"ins": F.lit(None).cast(dict(segs.dtypes)["ins"]), "del": F.lit(None).cast(dict(segs.dtypes)["del"])}), paras, _two_times(spark, sf_dir))
    return rows.select("doc_id", "at_ms", "text")


_SHOWN = "case when (not said or made <= at_ms) and not (said and turn % 4 = 1 and gone <= at_ms) then text else '' end"


@query(f"with {_TURNS} select doc_id, at_ms, string_agg({_SHOWN}, chr(10) order by turn) as text from t, points where true group by doc_id, at_ms")
def para_text_at(spark, sf_dir):
    segs, paras = adapters.conversation_segments(table(spark, sf_dir, "conversations"))
    return positions.text_at(segs, paras, _two_times(spark, sf_dir)).select("doc_id", "at_ms", "text")


@query(f"with {_TURNS} select doc_id, at_ms, string_agg({_SHOWN}, chr(10) order by turn) as text from t, points where true group by doc_id, at_ms")
def version_text(spark, sf_dir):
    segs, paras = adapters.conversation_segments(table(spark, sf_dir, "conversations"))
    return positions.joined_text_at(segs, paras, _two_times(spark, sf_dir)).select("doc_id", "at_ms", "text")


@query("""with t as (select conv_id as doc_id, turn, role = 'assistant' as said, role = 'assistant' and turn % 4 = 1 as gone, coalesce(text, '') as text from conversations),
  u as (select *, length(text) + length(regexp_replace(text, '[^\\x{10000}-\\x{10FFFF}]', '', 'g')) as n from t), o as (select *, coalesce(sum(case when gone then 1 else n + 1 end) over (partition by doc_id order by turn rows between unbounded preceding and 1 preceding), 0) as s from u)
  select doc_id, 'ins' as type, 'i' || turn as rev_id, cast(s as integer) as start_offset, cast(s + case when gone then 0 else n end as integer) as end_offset, cast(n as integer) as chars, cast(case when gone then 0 else n end as integer) as final_chars from o where said
  union all select doc_id, 'del', 'd' || turn, cast(s as integer), cast(s as integer), cast(n as integer), 0 from o where gone""")
def final_positions(spark, sf_dir):
    segs, paras = adapters.conversation_segments(table(spark, sf_dir, "conversations"))
    return positions.final_positions(segs, paras).select("doc_id", "type", "rev_id", "start_offset", "end_offset", "chars", "final_chars")


def _edit_places_sql(marks: bool) -> str:
    """One state of the document for each change: its pieces, those that show, and the paragraphs with one."""
    mark = "made, gone" if marks else "null, null"
    return f"""with t as (select conv_id as doc_id, turn, coalesce(text, '') as text, role = 'assistant' as said, 1704067200000 + turn * 60000 as since, turn % 4 = 1 as out from conversations),
  u as (select *, length(text) + length(regexp_replace(text, '[^\\x{{10000}}-\\x{{10FFFF}}]', '', 'g')) as n, case when said then since end as made, case when said and out then since + 3600000 end as gone from t),
  pieces as (select doc_id, turn, 0 as seg, n, made, gone from u union all select doc_id, turn, 1, 0, {mark} from u),
  changes as (select doc_id, turn, 'ins' as type, 'i' || turn as rev_id, made as ms from u where said union all select doc_id, turn, 'del', 'd' || turn, gone - 1 from u where gone is not null),
  state as (select c.doc_id, c.type, c.rev_id, c.turn, c.ms, p.turn as para, sum(case when (made is null or made <= ms) and (gone is null or gone > ms) then n else 0 end) as chars, bool_or((made is null or made <= ms) and (gone is null or gone > ms)) as there
    from changes c join pieces p using (doc_id) group by 1, 2, 3, 4, 5, 6),
  s as (select doc_id, type, rev_id, coalesce(sum(chars) filter (para < turn), 0) as before, count(*) filter (there and para < turn) as nth, bool_or(there) filter (para = turn) as there, coalesce(sum(chars) filter (para = turn), 0) as own, count(*) filter (there) as total from state group by 1, 2, 3),
  b as (select *, case when not there and nth = total then 1 else 0 end as back from s)
  select doc_id, type, rev_id, cast(greatest(0, before + nth - back) as integer) as edit_start, cast(greatest(0, before + nth - back) + case when there then own else 0 end as integer) as edit_end, cast(greatest(0, nth - back) as integer) as edit_start_para, cast(greatest(0, nth - back) as integer) as edit_end_para,
    not there as edit_start_missing, not there as edit_end_missing from b"""


@query(_edit_places_sql(False))
def edit_positions(spark, sf_dir):
    """Places at the time of each edit, in documents all of whose paragraphs exist at all times."""
    segs, paras = adapters.conversation_segments(table(spark, sf_dir, "conversations"))
    return positions.edit_positions(segs, paras)


@query(_edit_places_sql(True))
def edit_positions_in_paragraphs(spark, sf_dir):
    """Places at the time of each edit, where paragraphs come and go with their text."""
    segs, paras = adapters.conversation_segments(table(spark, sf_dir, "conversations"))
    marks = segs.select("doc_id", "para_index", F.col("ins").alias("mark_ins"), F.col("del").alias("mark_del"))
    return positions.edit_positions(segs, paras.drop("mark_ins", "mark_del").join(marks, ["doc_id", "para_index"]))


@query(r"""with p as (select conv_id as doc_id, cast(turn as integer) as para_index, case when role = 'user' then regexp_extract(text, '^([^\n]*)', 1) end as heading from conversations)
  select doc_id, para_index, last_value(heading ignore nulls) over (partition by doc_id order by para_index rows unbounded preceding) as section from p""")
def asof_section(spark, sf_dir):
    paras = adapters.conversation_paragraphs(table(spark, sf_dir, "conversations")).withColumn("bookmark", F.lit(None).cast("string"))
    return targets.sections(paras).select("doc_id", "para_index", "section")


_POINTS = f"{_REV}, ends as (select doc_id, min(ms) as f, max(ms) as l from rev group by doc_id)"


def _changes_sql(points: str) -> str:
    return f"select p.doc_id, p.at_ms, p.label, count(r.ms) as changes from ({points}) p left join rev r on r.doc_id = p.doc_id and r.ms <= p.at_ms group by p.doc_id, p.at_ms, p.label"


@query(f"with {_POINTS} " + _changes_sql("select doc_id, f - 1 as at_ms, 'initial' as label from ends union all select distinct r.doc_id, least(f + greatest(1, (ms - f + 86399999) // 86400000) * 86400000, l), 'every' from rev r join ends using (doc_id)"))
def version_points_every(spark, sf_dir):
    return versions.version_points(_rev(spark, sf_dir), every_seconds=86_400)


@query(f"with {_POINTS}, n as (select doc_id, ms, lead(ms) over (partition by doc_id order by ms) as nx from rev) " + _changes_sql("select doc_id, f - 1 as at_ms, 'initial' as label from ends union all select distinct doc_id, ms, 'session' from n where nx is null or nx - ms > 14400000"))
def version_points_session(spark, sf_dir):
    return versions.version_points(_rev(spark, sf_dir), session_hours=4)


@query("""with r as (select cast(floor(user_id / 3) as bigint) as doc_id, event_id as seq, cast(value as bigint) as id from events where value is not null), l as (select *, lag(id) over (partition by doc_id order by seq) as b from r)
  select doc_id, count(*) as numbered, count(*) filter (id < b) as decreases from l group by doc_id""")
def id_order(spark, sf_dir):
    rows = table(spark, sf_dir, "events").where("value is not null").select(F.floor(F.col("user_id") / 3).cast("long").alias("doc_id"), F.col("event_id").alias("seq"), F.rint("value").cast("long").cast("string").alias("id"))
    return integrity.id_decreases(rows)


@query("""with r as (select cast(floor(user_id / 3) as bigint) as doc_id, cast(value as bigint) as id from events where value is not null), c as (select doc_id, id, count(*) as n from r group by doc_id, id)
  select doc_id, cast(sum(n) as bigint) as revisions, count(*) filter (n > 1) as duplicated from c group by doc_id""")
def duplicate_ids(spark, sf_dir):
    rows = table(spark, sf_dir, "events").where("value is not null").select(F.floor(F.col("user_id") / 3).cast("long").alias("doc_id"), F.rint("value").cast("long").cast("string").alias("id"))
    return integrity.duplicate_ids(rows)


@query("""with r as (select cast(floor(user_id / 3) as bigint) as doc_id, cast(json_extract(props, '$.k') as bigint) as k, event_type, cast(ceil(value) as bigint) as chars from events),
  known as (select distinct doc_id, k from r where event_type = 'signup') select doc_id, cast(sum(chars) as bigint) as untracked_chars, count(distinct k) as untracked_sessions
  from r where event_type = 'view' and chars > 0 and not exists (select 1 from known where known.doc_id = r.doc_id and known.k = r.k) group by doc_id""")
def tamper_untracked(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select(F.floor(F.col("user_id") / 3).cast("long").alias("doc_id"), F.get_json_object("props", "$.k").alias("rsid"), "event_type", F.ceil("value").cast("int").alias("chars")).withColumn("template_id", F.col("doc_id"))
    return tamper.untracked_text(rows.where("event_type = 'view'").withColumn("tracked", F.lit(False)), rows.where("event_type = 'signup'"))


_FLOW = f"""{_REV}, c as (select *, seq % 5 = 0 as move, cast(seq % 40 as integer) as para_index from rev), lagged as (select *, ms - lag(ms) over (partition by doc_id order by ms, type, rev_id) as gap from c),
  s as (select *, cast(sum(case when gap > 21600000 then 1 else 0 end) over (partition by doc_id order by ms, type, rev_id rows unbounded preceding) as integer) as session from lagged),
  g as (select *, sum(case when type = 'ins' and not move then chars else 0 end) over (partition by doc_id, session, author, ms) as grp, sum(case when type = 'del' and not move then chars else 0 end) over (partition by doc_id, session, rev_id) as del_total from s),
  f as (select *, (type = 'ins' and not move and grp < 150) or (type = 'del' and not move and grp < 150 and del_total < 150) as fine, type = 'ins' and not move and grp >= 150 as bulk from g)"""


def _flow(spark, sf_dir):
    segs, paras = adapters.segments(_rev(spark, sf_dir))
    return flow.build(segs, paras, hours=6)


@query(f"with {_FLOW} select doc_id, session, min(ms) as start, max(ms) as \"end\", count(*) as changes from f group by doc_id, session")
def flow_sessions(spark, sf_dir):
    return _ms(_flow(spark, sf_dir)["sessions"], "start", "end")


_HEAT = f"""{_FLOW}, h as (select doc_id, session, para_index, cast(sum(case when type = 'ins' and not move then chars else 0 end) as bigint) as ins_chars, cast(sum(case when type = 'del' and not move then chars else 0 end) as bigint) as del_chars,
  cast(sum(case when bulk then chars else 0 end) as bigint) as bulk_chars, cast(sum(case when type = 'ins' and move then chars else 0 end) as bigint) as moved_in, cast(sum(case when type = 'del' and move then chars else 0 end) as bigint) as moved_out,
  cast(sum(case when fine then chars else 0 end) as bigint) as fine_chars, count(*) filter (fine) as fine_changes, max(ms) as last from f group by doc_id, session, para_index having sum(chars) > 0),
  ends as (select doc_id, session, max(ms) as e from f group by doc_id, session),
  v as (select h.doc_id, h.session, h.para_index, cast(sum(case when (c.type = 'ins' and c.ms <= e) or (c.type = 'del' and c.ms > e) then c.chars else 0 end) as bigint) as visible from h join ends using (doc_id, session) join c on c.doc_id = h.doc_id and c.para_index = h.para_index group by all)"""


@query(f"""with {_HEAT} select h.doc_id, h.session, h.para_index, ins_chars, del_chars, bulk_chars, moved_in, moved_out, fine_chars, fine_changes,
  case when fine_chars > 0 then least(1.0::double, greatest(fine_chars / greatest(visible, 40)::double, fine_changes / 8.0::double)) else 0.0::double end as green, case when visible > 0 then least(1.0::double, bulk_chars / visible::double) else 0.0::double end as orange from h join v using (doc_id, session, para_index)""")
def para_heat(spark, sf_dir):
    return _flow(spark, sf_dir)["heat"].select("doc_id", "session", "para_index", "ins_chars", "del_chars", "bulk_chars", "moved_in", "moved_out", "fine_chars", "fine_changes", "green", "orange")


@query(f"with {_HEAT} select doc_id, session, cast(sum(ins_chars) as bigint) as ins_chars, cast(sum(del_chars) as bigint) as del_chars, cast(sum(bulk_chars) as bigint) as bulk_chars, cast(sum(moved_in) as bigint) as moved_in from h group by doc_id, session")
def flow_totals(spark, sf_dir):
    return _flow(spark, sf_dir)["totals"].select("doc_id", "session", "ins_chars", "del_chars", "bulk_chars", "moved_in")


@query(f"""with {_HEAT}, b as (select doc_id, session, 'bulk' as category, cast(sum(bulk_chars) as bigint) as chars from h where bulk_chars > 0 group by doc_id, session) select * from b""")
def flow_highlights(spark, sf_dir):
    """The highlighted characters of each session by category."""
    return _flow(spark, sf_dir)["totals"].select("doc_id", "session", F.explode("highlight_chars").alias("category", "chars"))


_UNIT = "case when {0} % 10 >= 6 then 't' || {0} // 10 else 'p' || {0} end"


@query(f"""with {_HEAT}, seen as (select st.doc_id, st.session, c.para_index, cast(sum(case when (c.type = 'ins' and c.ms <= e) or (c.type = 'del' and c.ms > e) then c.chars else 0 end) as bigint) as visible from ends st join c on c.doc_id = st.doc_id group by all),
  z as (select s.doc_id, s.session, {_UNIT.format("s.para_index")} as unit, visible, coalesce(ins_chars, 0) as ins, coalesce(del_chars, 0) as del, coalesce(bulk_chars, 0) as bulk, coalesce(moved_in, 0) as come, coalesce(moved_out, 0) as gone,
    case when coalesce(fine_chars, 0) > 0 then least(1.0::double, greatest(fine_chars / greatest(visible, 40)::double, fine_changes / 8.0::double)) else 0.0::double end as green, case when visible > 0 then least(1.0::double, coalesce(bulk_chars, 0) / visible::double) else 0.0::double end as orange from seen s left join h using (doc_id, session, para_index)),
  u as (select doc_id, session, unit, sum(visible) as visible, sum(bulk) as bulk, sum(come) as come, sum(gone) as gone, greatest(0, sum(ins - bulk - come + del - gone)) as fine, max(greatest(green, orange)) as heat from z group by 1, 2, 3),
  t as (select *, case when fine = 0 and bulk = 0 then case when come > 0 or gone > 0 then 'moved' else 'unchanged' end when bulk > 0 and bulk >= fine then 'bulk' else 'fine' end as change from u)
  select doc_id, session, unit, change, false as added_by_bulk, case when change = 'bulk' then 'bulk' end as category, floor(case change when 'bulk' then least(1.0::double, bulk / greatest(visible, 1)::double) when 'fine' then heat else 1.0::double end * 1000000 + 0.5) / 1000000 as intensity from t""")
def unit_changes(spark, sf_dir):
    return _flow(spark, sf_dir)["units"].select("doc_id", "session", "unit", "change", "added_by_bulk", "category", rounded(F.col("intensity"), 6).alias("intensity"))


@query(f"""with {_FLOW}, m as (select doc_id, session, 'm' || seq % 50 as name, type, para_index, case when para_index % 10 >= 6 then 't' || para_index // 10 else 'p' || para_index end as unit, chars from f where move),
  i as (select doc_id, session, name, cast(sum(chars) as bigint) as chars, list(distinct para_index) as paras from m where type = 'ins' group by 1, 2, 3), d as (select doc_id, session, name, list(distinct para_index) as paras from m where type = 'del' group by 1, 2, 3),
  p as (select i.doc_id, i.session, unnest(d.paras) as a, i.paras as bs, i.chars from i join d using (doc_id, session, name)), q as (select doc_id, session, a, unnest(bs) as b, chars from p)
  select doc_id, session, case when a % 10 >= 6 then 't' || a // 10 else 'p' || a end as from_unit, case when b % 10 >= 6 then 't' || b // 10 else 'p' || b end as to_unit, 'move' as kind, cast(sum(chars) as bigint) as chars from q group by 1, 2, 3, 4""")
def flow_links(spark, sf_dir):
    return _flow(spark, sf_dir)["links"]


@query(f"""with {_REPEATED}, lagged as (select *, ms - lag(ms) over (partition by doc_id order by ms, type, rev_id) as gap from c),
  f as (select *, 20 + k as n, cast(sum(case when gap > 21600000 then 1 else 0 end) over (partition by doc_id order by ms, type, rev_id rows unbounded preceding) as integer) as session from lagged),
  m as (select doc_id, session, 'm' || seq % 50 as name, type, para_index, n from f where move), i as (select doc_id, session, name, sum(n) as n, list(distinct para_index) as paras from m where type = 'ins' group by 1, 2, 3), d as (select doc_id, session, name, list(distinct para_index) as paras from m where type = 'del' group by 1, 2, 3),
  p as (select i.doc_id, i.session, unnest(d.paras) as a, i.paras as bs, i.n from i join d using (doc_id, session, name)),
  q as (select doc_id, session, a, unnest(bs) as b, n, 0 as o from p union all select i.doc_id, i.session, d.para_index, i.para_index, i.n, 1 from f i join (select distinct doc_id, session, k, para_index from f where type = 'del' and not move) d on d.doc_id = i.doc_id and d.session = i.session and d.k = i.k where i.type = 'ins' and not i.move)
  select doc_id, session, {_UNIT.format("a")} as from_unit, {_UNIT.format("b")} as to_unit, case min(o) when 0 then 'move' else 'relocate' end as kind, cast(sum(n) as bigint) as chars from q group by 1, 2, 3, 4""")
def relocation_links(spark, sf_dir):
    """Links of text that was deleted in one place and inserted in another in a session, where texts repeat, beside marked moves."""
    segs, paras = adapters.segments(_rev(spark, sf_dir))
    return flow.build(segs.withColumn("text", adapters.repeated_text(F.col("seg_index"))), paras, hours=6)["links"]


_COMMENTS = """e as (select user_id as key, cast(floor(user_id / 3) as bigint) as doc_id, event_id + 1 as seq, epoch_us(ts) // 1000 as happened, case event_type when 'view' then 'edited' when 'signup' then 'seen' when 'click' then 'resolved' when 'purchase' then 'reopened' else 'removed' end as type, cast(event_id as varchar) as text from events),
  s as (select *, min(seq) filter (type = 'seen') over (partition by doc_id, key) as f from e), v as (select * from s where seq >= f)"""


def _comment_events(spark, sf_dir):
    kind = F.col("event_type")
    kind = F.when(kind == "view", "edited").when(kind == "signup", "seen").when(kind == "click", "resolved").when(kind == "purchase", "reopened").otherwise("removed")
    carries = kind.isin("seen", "edited")
    return table(spark, sf_dir, "events").select(F.floor(F.col("user_id") / 3).cast("long").alias("doc_id"), F.col("user_id").alias("key"), (F.col("event_id") + 1).alias("seq"), millis(F.col("ts")).alias("at"), kind.alias("type"), F.when(carries, F.col("event_id").cast("string")).alias("text"), F.when(carries, F.lit(False)).alias("done"))


@query(f"""with {_COMMENTS} select doc_id, key, max(seq) filter (type = 'seen') as seq, max_by(happened, seq) filter (type = 'seen') as first_seen, max_by(text, seq) filter (type in ('seen', 'edited')) as text, max_by(type = 'resolved', seq) filter (type <> 'removed') as done,
  max_by(type <> 'removed', seq) filter (type in ('seen', 'edited', 'removed')) as present, case when max_by(type, seq) filter (type in ('seen', 'edited', 'removed')) = 'removed' then max_by(happened, seq) filter (type = 'removed') else -1 end as removed_at from v group by doc_id, key""")
def comment_replay(spark, sf_dir):
    rows = comments.replay(_comment_events(spark, sf_dir)).drop("receipt_at")
    return rows.withColumn("removed_at", F.coalesce("removed_at", F.lit(-1)))


@query(f"""with {_COMMENTS}, st as (select doc_id, key, max_by(text, seq) filter (type in ('seen', 'edited')) as text, max_by(type = 'resolved', seq) filter (type <> 'removed') as done, max_by(type <> 'removed', seq) filter (type in ('seen', 'edited', 'removed')) as present from v group by doc_id, key),
  now as (select cast(floor(user_id / 3) as bigint) as doc_id, user_id as key, cast(max(event_id) as varchar) as text, count(*) % 2 = 0 as done from events where event_type = 'view' group by 1, 2),
  b as (select coalesce(st.doc_id, now.doc_id) as doc_id, coalesce(st.key, now.key) as key, st.text as s_text, st.done as s_done, present, now.text as c_text, now.done as c_done from st full join now on st.doc_id = now.doc_id and st.key = now.key)
  select doc_id, key, case when c_text is not null and present is null then 'seen' when c_text is not null and not present then 'reappeared' when c_text is not null and s_text <> c_text then 'edited' when c_text is null and present then 'removed' end as type from b
    where (c_text is not null and (present is null or not present or s_text <> c_text)) or (c_text is null and present)
  union all select doc_id, key, case when c_done then 'resolved' else 'reopened' end from b where c_text is not null and present is not null and s_done <> c_done""")
def comment_diff(spark, sf_dir):
    state = comments.replay(_comment_events(spark, sf_dir))
    now = table(spark, sf_dir, "events").where("event_type = 'view'").groupBy(F.floor(F.col("user_id") / 3).cast("long").alias("doc_id"), F.col("user_id").alias("key")).agg(F.max("event_id").cast("string").alias("text"), (F.count(F.lit(1)) % 2 == 0).alias("done"))
    now = now.withColumns({"nth": F.lit(0), "author": F.lit("someone")})
    docs = table(spark, sf_dir, "events").select(F.floor(F.col("user_id") / 3).cast("long").alias("doc_id")).distinct().withColumns({"at": F.lit(0).cast("long"), "sha256": F.lit("")})
    return comments.diff(state, now, docs).select("doc_id", "key", "type")


@query("""with t as (select conv_id as doc_id, turn, role, coalesce(text, '') as text from conversations where role = 'assistant'), u as (select *, length(text) + length(regexp_replace(text, '[^\\x{10000}-\\x{10FFFF}]', '', 'g')) as n from t)
  select doc_id, 'ins' as type, 'i' || turn as rev_id, role as author, 1704067200000 + turn * 60000 as at, cast(n as integer) as chars, text from u union all select doc_id, 'del', 'd' || turn, role, 1704067200000 + turn * 60000, cast(n as integer), text from u where turn % 3 = 0""")
def docx_revisions(spark, sf_dir):
    """Changes read back from files made of the conversations."""
    rows = docx.revisions(adapters.conversation_files(table(spark, sf_dir, "conversations")))
    return rows.select("doc_id", "type", "rev_id", "author", millis(F.col("ts")).alias("at"), "chars", "text")


@query("""with t as (select conv_id as doc_id, turn, role = 'assistant' as said, coalesce(text, '') as text from conversations), u as (select *, length(text) + length(regexp_replace(text, '[^\\x{10000}-\\x{10FFFF}]', '', 'g')) as n from t)
  select doc_id, cast(sum(case when said and turn % 3 = 0 then 0 else n end) as integer) as final_chars, cast(sum(case when said then n else 0 end) as integer) as inserted, cast(sum(case when said and turn % 3 = 0 then n else 0 end) as integer) as deleted, true as track_revisions from u group by doc_id""")
def docx_stats(spark, sf_dir):
    return docx.stats(adapters.conversation_files(table(spark, sf_dir, "conversations"))).select("doc_id", "final_chars", "inserted", "deleted", "track_revisions")


@query("""select conv_id as doc_id, string_agg(case when role = 'assistant' and (turn > 2 or turn % 3 = 0) then '' else coalesce(text, '') end, chr(10) order by turn) as text from conversations group by conv_id""")
def docx_versions(spark, sf_dir):
    """The files as they were at two minutes past midnight, and the text of those."""
    files = adapters.conversation_files(table(spark, sf_dir, "conversations"))
    made = docx_edit.versions(files.select("doc_id", F.lit(1_704_067_320_000).alias("at_ms"), F.lit("at").alias("label"), "content")).withColumn("path", F.lit(""))
    segs, paras = docx.segments(made), docx.paragraphs(made)
    return positions.text_at(segs, paras).select("doc_id", "text")


@query("""with t as (select conv_id as doc_id, turn, role, coalesce(text, '') as text, role = 'assistant' as said, role = 'assistant' and turn % 3 = 0 as gone from conversations),
  n as (select doc_id, count(*) filter (said) as revisions, count(*) filter (gone and text <> '') as twice, count(distinct turn) filter (said) as ids from t group by doc_id),
  i as (select doc_id, unnest(['settings', 'undated', 'duplicateIds', 'idOrder', 'futureDates', 'beforeCreated', 'deletedBeforeInserted', 'rsids', 'application']) as item, revisions, twice, ids from n)
  select doc_id, item, case when item = 'settings' then false when item in ('undated', 'futureDates') and revisions > 0 then false when item = 'duplicateIds' and revisions > 0 then ids < revisions when item = 'deletedBeforeInserted' and twice > 0 then false end as observed from i""")
def docx_integrity(spark, sf_dir):
    files = adapters.conversation_files(table(spark, sf_dir, "conversations"))
    return integrity.check(docx.facts(files), docx.segments(files), F.lit("2026-01-01").cast("timestamp")).select("doc_id", "item", "observed")


@query("select distinct conv_id as doc_id, 'trackingOff' as evidence from conversations where conv_id % 2 <> 0")
def docx_tamper(spark, sf_dir):
    facts = docx.facts(adapters.conversation_files(table(spark, sf_dir, "conversations")))
    return tamper.check(facts.withColumn("track_revisions", F.col("doc_id") % 2 == 0)).select("doc_id", "evidence")


def _nodes(spark, sf_dir, wanted):
    return stored(nodes.nodes(adapters.structured_files(table(spark, sf_dir, "conversations")), wanted), "nodes")


_DOCS = "docs as (select distinct conv_id as doc_id, 3 + conv_id % 15 as n from conversations)"
_CHAINS = f"""{_DOCS}, st as (select doc_id, n, unnest(range(n)) as k from docs),
  walk as (select doc_id, n, k as style, k as pos, 0 as far from st union all select doc_id, n, style, case when pos > 0 then pos - 1 else n - 1 end, far + 1 from walk where far < 11 and (pos > 0 or doc_id % 4 = 0)),
  props as (select *, unnest([case when pos % 5 = 1 then 'pPr/jc' end, case when pos % 7 = 2 then 'pPr/outlineLvl' end, case when pos % 3 = 0 then 'rPr/sz' end, case when pos = 1 then 'rPr/b' end]) as name,
    unnest(['j' || pos, cast(pos % 11 as varchar), cast(20 + pos as varchar), 'true']) as value from walk),
  levels as (select doc_id, style, min_by(case when pos % 7 = 2 and pos % 11 < 9 then pos % 11 + 1 else pos % 9 + 1 end, far) as heading_level from walk where far < 10 and ((pos % 7 = 2 and pos % 11 < 9) or pos % 6 = 5) group by 1, 2)"""


@query(f"""with recursive {_CHAINS}, r as (select doc_id, style, name, min_by(value, far) as value from props where name is not null group by 1, 2, 3)
  select r.doc_id, 's' || style as style, name, value, cast(heading_level as integer) as heading_level from r left join levels using (doc_id, style)""")
def docx_style_chains(spark, sf_dir):
    """Each style's properties and heading level, with those of the up to eleven styles above; some files' styles are based on each other in a ring."""
    rows = structure.resolved_styles(stored(structure.styles(_nodes(spark, sf_dir, structure.FOR_STYLES)), "styles"))
    return rows.select("doc_id", "style", "heading_level", F.explode("properties").alias("name", "value"))


_WORDS = """t as (select conv_id as doc_id, turn, unnest(string_split(coalesce(text, ''), ' ')) as word, generate_subscripts(string_split(coalesce(text, ''), ' '), 1) as j from conversations),
  p as (select doc_id, word, row_number() over (partition by doc_id order by turn, j) - 1 as place from t),
  u as (select *, length(word) % 4 as level, case when place % 3 = 0 then 2 else 1 end as num from p)"""


@query(f"""with recursive {_WORDS}, o as (select *, row_number() over (partition by doc_id, num order by place) as r from u),
  walk as (select doc_id, num, r, place, level, list_transform(range(4), lambda k: case when k = level then 1 else 0 end) as c from o where r = 1
    union all select o.doc_id, o.num, o.r, o.place, o.level, list_transform(c, lambda x, i: case when i - 1 > o.level then 0 when i - 1 = o.level then x + 1 else x end) from walk w join o on o.doc_id = w.doc_id and o.num = w.num and o.r = w.r + 1),
  s as (select *, list_transform(c[1 : level + 1], lambda x, i: greatest(1, x) + case when num = 2 then case when i = 1 then 4 else 0 end else (i - 1) % 2 end) as n from walk)
  select doc_id, cast(place as integer) as para_index, cast(level as integer) as level, case when num = 1 then array_to_string(n, '.') else '(' || repeat(chr(cast(97 + (n[level + 1] - 1) % 26 as integer)), cast((n[level + 1] - 1) // 26 + 1 as integer)) || ')' end as label from s""")
def docx_list_labels(spark, sf_dir):
    """What the numbers of nested lists come to: figures by levels, or letters."""
    rows = _nodes(spark, sf_dir, structure.FOR_PARAGRAPHS)
    found = structure.labels(structure.listed(rows.where("in_tbl is null")), structure.numbering(rows))
    return found.select("doc_id", "para_index", "level", "label")


@query(f"""with recursive {_CHAINS}, {_WORDS}, r as (select doc_id, style, min_by(value, far) filter (name = 'pPr/jc') as jc, min_by(value, far) filter (name = 'rPr/sz') as sz from props group by 1, 2),
  w as (select u.*, u.place % (n + 1) as style from u join docs using (doc_id))
  select w.doc_id, cast(place as integer) as para_index, 's' || style as style, jc, sz, cast(heading_level as integer) as heading_level from w left join r using (doc_id, style) left join levels using (doc_id, style)""")
def docx_paragraph_looks(spark, sf_dir):
    """The alignment, size and heading level of each paragraph, by way of its style; some name a style that isn't there."""
    rows = structure.paragraphs(_nodes(spark, sf_dir, structure.FOR_PARAGRAPHS).where("in_tbl is null"))
    at = lambda name: F.try_element_at("properties", F.lit(name))
    return rows.select("doc_id", "para_index", "style", at("pPr/jc").alias("jc"), at("rPr/sz").alias("sz"), "heading_level")


@query("""with t as (select conv_id as doc_id, turn, row_number() over (partition by conv_id order by turn) - 1 as nth from conversations), r as (select *, unnest(range(2 + turn % 4)) as row from t), c as (select *, unnest(range(1 + (row + doc_id) % 4)) as cell from r),
  s as (select *, case when (row + cell) % 2 = 1 then 1 + (row * 2 + cell + turn) % 3 else 1 end as col_span, cell % 2 = 0 and (row + turn) % 3 <> 0 as goes_on from c),
  p as (select *, case when row % 3 = 2 then 1 else 0 end + coalesce(sum(col_span) over (partition by doc_id, nth, row order by cell rows between unbounded preceding and 1 preceding), 0) as col from s),
  h as (select a.*, (select max(b.row) from p b where b.doc_id = a.doc_id and b.nth = a.nth and b.col = a.col and b.row <= a.row and (not b.goes_on or not exists (select 1 from p d where d.doc_id = b.doc_id and d.nth = b.nth and d.col = b.col and d.row = b.row - 1))) as first_row from p a)
  select doc_id, cast(nth as integer) as nth, cast(row as integer) as row, cast(cell as integer) as cell, cast(col as integer) as col, cast(col_span as integer) as col_span, cast(count(*) over (partition by doc_id, nth, col, first_row) as integer) as row_span, cast(first_row as integer) as first_row from h""")
def docx_table_cells(spark, sf_dir):
    """Where the cells of tables are, and how many columns and rows each takes."""
    rows = structure.cells(_nodes(spark, sf_dir, structure.FOR_CELLS))
    nth = (F.dense_rank().over(W.partitionBy("doc_id").orderBy("table")) - 1).alias("nth")
    return rows.select("doc_id", nth, "row", "cell", "col", "col_span", "row_span", "first_row")


@query(f"with {_buckets_sql('86400')}, p as (select doc_id, bucket, unnest(['chart:bar:fine:', 'chart:bar:bulk:', 'chart:bar:deleted:', 'chart:line:total:']) as k, unnest([fine, bulk, deleted, total_at_end]) as value from running) select doc_id, bucket, k || bucket as key, value from p where value <> 0 or k = 'chart:line:total:'")
def figure_targets(spark, sf_dir):
    return targets.bucket_targets(_bucket_rows(spark, sf_dir, "day")).select("doc_id", "bucket", "key", "value")


@query("select 'k' || cast(json_extract(props, '$.k') as bigint) as key, count(*) as notes from events group by 1")
def annotation_keys(spark, sf_dir):
    return table(spark, sf_dir, "events").groupBy(key(F.concat(F.lit("k"), F.get_json_object("props", "$.k"))).alias("key")).agg(F.count(F.lit(1)).alias("notes"))


@query(f"""with {_buckets_sql('86400')}, p as (select doc_id, bucket, unnest(['chart:bar:fine:', 'chart:bar:bulk:', 'chart:bar:deleted:', 'chart:line:total:']) as k, unnest([fine, bulk, deleted, total_at_end]) as value from running),
  t as (select doc_id, k || bucket as key, value from p where value <> 0 or k = 'chart:line:total:'),
  n as (select event_id as nth, (case when event_type = 'error' then 'chart:bar:deleted:' else 'chart:bar:fine:' end) || event_id % 400 as key, case when event_id % 3 > 0 then event_type || ' ' || event_id end as tooltip, case when event_id % 5 = 1 then 'https://notes.example/' || event_id end as href from events),
  a as (select key, coalesce(string_agg(tooltip, chr(10) order by nth), '') as tooltip, min_by(href, nth) filter (href is not null) as href from n group by key)
  select doc_id, t.key, value, tooltip, href from t left join a on a.key = t.key""")
def annotated_targets(spark, sf_dir):
    """Parts of the chart with the notes that users attached: all tooltips, and the first link that is safe."""
    n = F.col("event_id")
    part = F.when(F.col("event_type") == "error", "chart:bar:deleted:").otherwise("chart:bar:fine:")
    notes = table(spark, sf_dir, "events").select(n.alias("nth"), F.concat(part, n % 400).alias("target"), F.when(n % 3 > 0, F.concat_ws(" ", "event_type", n)).alias("tooltip"), F.when(n % 5 == 1, F.concat(F.lit("https://notes.example/"), n)).when(n % 5 == 0, F.concat(F.lit("javascript:"), n)).alias("href"))
    return targets.annotated(targets.bucket_targets(_bucket_rows(spark, sf_dir, "day")), notes).select("doc_id", "key", "value", "tooltip", "href")


@query(r"""with t as (select conv_id as doc_id, cast(turn as integer) as turn, role, coalesce(text, '') as text from conversations),
  c as (select doc_id, 1704067200000 + turn * 60000 as ms from t where role = 'assistant' union select doc_id, 1704067200000 + turn * 60000 + 3600000 from t where role = 'assistant' and turn % 4 = 1),
  s as (select doc_id, cast(sum(case when gap > 1800000 then 1 else 0 end) over (partition by doc_id order by ms rows unbounded preceding) as integer) as session from (select *, ms - lag(ms) over (partition by doc_id order by ms) as gap from c)),
  p as (select *, last_value(case when role = 'user' then regexp_extract(text, '^([^\n]*)', 1) end ignore nulls) over (partition by doc_id order by turn rows unbounded preceding) as section, trim(regexp_replace(text, '{WS}', ' ', 'g')) as flat from t)
  select p.doc_id, 'flow:' || session || ':p' || turn as key, session, turn as first_para, section, case when length(flat) > 40 then flat[1:40] || '…' else flat end as excerpt from p join (select distinct * from s) s on s.doc_id = p.doc_id""".replace("{WS}", _WS))
def enriched_targets(spark, sf_dir):
    """Parts of the flow figure with the section that each is in and the start of its text."""
    said = table(spark, sf_dir, "conversations")
    segs, paras = adapters.conversation_segments(said)
    turns = adapters.conversation_paragraphs(said).withColumn("bookmark", F.lit(None).cast("string"))
    parts = targets.flow_targets(flow.build(segs, paras, hours=0.5)["units"])
    return targets.enriched(parts, targets.sections(turns), turns).select("doc_id", "key", "session", "first_para", "section", "excerpt")
