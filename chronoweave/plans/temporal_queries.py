"""Timelines: successors, clusters, band, interval and as-of joins, rollups over events and orders."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from chronoweave.functions.ids import hashed_id
from chronoweave.operators import graph, temporal
from chronoweave.plans.registry import day, long, query

EVENT_ORDER = ["ts", "event_id"]


def episodes(events, minutes: int = 360):
    """Events with episode_no: a user's runs without a gap of more than so many minutes."""
    gap = F.expr("timestampdiff(SECOND, _before.ts, ts)")
    return temporal.gap_clusters(events, ["user_id"], EVENT_ORDER, gap, minutes * 60, "episode_no")


EPISODES_SQL = """
clustered AS (
  SELECT *, sum(CASE WHEN gap <= 21600 THEN 0 ELSE 1 END) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS episode_no
  FROM (SELECT *, date_sub('second', lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id), ts) AS gap FROM events)
)"""


@query(f"""WITH {EPISODES_SQL}
SELECT user_id, CAST(episode_no AS BIGINT) AS episode_no, event_type, count(*) AS n, min(value) AS min_value, max(value) AS max_value,
       round(avg(value), 6) AS mean_value, arg_min(event_id, (value, ts, event_id)) AS min_event, arg_max(event_id, (value, -epoch_us(ts), -event_id)) AS max_event
FROM clustered GROUP BY user_id, episode_no, event_type""")
def measurement_summary(t):
    e = episodes(t("events"))
    first = lambda v: F.struct(v, F.expr("-unix_micros(cast(ts as timestamp))"), -F.col("event_id"))
    return e.groupBy("user_id", long("episode_no").alias("episode_no"), "event_type").agg(
        F.count("*").alias("n"), F.min("value").alias("min_value"), F.max("value").alias("max_value"), F.round(F.avg("value"), 6).alias("mean_value"),
        F.min_by("event_id", F.struct("value", "ts", "event_id")).alias("min_event"), F.max_by("event_id", first(F.col("value"))).alias("max_event"),
    )


@query(f"""WITH {EPISODES_SQL}
SELECT user_id, CAST(episode_no AS BIGINT) AS episode_no, count(*) AS n, min(event_id) AS first_event, max(event_id) AS last_event
FROM clustered GROUP BY user_id, episode_no""")
def gap_cluster(t):
    return episodes(t("events")).groupBy("user_id", long("episode_no").alias("episode_no")).agg(F.count("*").alias("n"), F.min("event_id").alias("first_event"), F.max("event_id").alias("last_event"))


@query("""SELECT user_id, event_id AS src, next_id AS dst, CAST(date_diff('day', CAST(ts AS DATE), CAST(next_ts AS DATE)) AS BIGINT) AS days_between
FROM (SELECT *, lead(event_id) OVER w AS next_id, lead(ts) OVER w AS next_ts FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)) WHERE next_id IS NOT NULL""")
def precedes_edges(t):
    e = temporal.successors(t("events").select("user_id", "event_id", "ts"), ["user_id"], EVENT_ORDER, ["event_id", "ts"])
    return e.select("user_id", F.col("event_id").alias("src"), F.col("next_event_id").alias("dst"), long(F.datediff(day("next_ts"), day("ts"))).alias("days_between"))


@query("""SELECT a.user_id, a.event_id AS src, b.event_id AS dst FROM events a JOIN events b
ON a.user_id = b.user_id AND CAST(a.ts AS DATE) = CAST(b.ts AS DATE) AND a.event_id <> b.event_id""")
def same_day_pairs(t):
    e = t("events").select("user_id", "event_id", day("ts").alias("day"))
    return graph.same_day_edges(e, ["user_id"], "day", "event_id").select("user_id", "src", "dst")


@query("""SELECT event_id, substr(md5(concat_ws('_', CAST(user_id AS VARCHAR), event_type, props)), 1, 24) AS node_id FROM events""")
def evt_ids_md5(t):
    return t("events").select("event_id", hashed_id(F.col("user_id"), F.col("event_type"), F.col("props")).alias("node_id"))


@query("""SELECT event_id, user_id FROM (SELECT *, row_number() OVER w AS seq, min(CASE WHEN event_type = 'error' THEN event_id END) OVER (PARTITION BY user_id) AS cut FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id))
WHERE cut IS NULL OR event_id < cut""")
def truncate_at_cutoff(t):
    first = F.min(F.when(F.col("event_type") == "error", F.col("event_id"))).over(W.partitionBy("user_id"))
    return t("events").withColumn("cut", first).where("cut is null or event_id < cut").select("event_id", "user_id")


@query("SELECT event_id, user_id, event_type, value FROM events WHERE event_type IN ('view', 'purchase', 'signup')")
def filter_types(t):
    return t("events").where(F.col("event_type").isin("view", "purchase", "signup")).select("event_id", "user_id", "event_type", "value")


@query("""SELECT user_id, event_id, event_type FROM events WHERE CAST(ts AS DATE) BETWEEN DATE '2024-01-05' AND DATE '2024-01-09'""")
def events_between(t):
    return t("events").where("ts >= timestamp_ntz'2024-01-05' and ts < timestamp_ntz'2024-01-10'").select("user_id", "event_id", "event_type")


@query("""SELECT o_orderkey FROM orders WHERE o_totalprice BETWEEN 1000 AND 90000 AND o_orderdate >= TIMESTAMP '1996-01-01' AND o_orderdate < TIMESTAMP '1998-01-01'""")
def index_filter(t):
    return t("orders").where("o_totalprice between 1000 and 90000 and o_orderdate >= timestamp_ntz'1996-01-01' and o_orderdate < timestamp_ntz'1998-01-01'").select("o_orderkey")


@query("""SELECT a.event_id AS anchor, b.event_id FROM events a JOIN events b ON a.user_id = b.user_id AND abs(date_diff('day', CAST(a.ts AS DATE), CAST(b.ts AS DATE))) <= 2
WHERE a.event_type = 'purchase' AND a.value > 100""")
def near_anchor(t):
    e = t("events").select("user_id", "event_id", "event_type", "value", day("ts").alias("d"))
    anchors = e.where("event_type = 'purchase' and value > 100").select("user_id", F.col("event_id").alias("anchor"), F.col("d").alias("ad"))
    return temporal.band_join(anchors, e, ["user_id"], "ad", "d", 2).select("anchor", "event_id")


BAND = "FROM events a WHERE a.event_type = 'error' AND {} (SELECT 1 FROM events b WHERE b.event_type = 'purchase' AND b.user_id = a.user_id AND abs(date_diff('day', CAST(a.ts AS DATE), CAST(b.ts AS DATE))) <= 1)"


def _band(t, how):
    e = t("events").select("user_id", "event_id", "event_type", day("ts").alias("d"))
    return temporal.band_join(e.where("event_type = 'error'"), e.where("event_type = 'purchase'").select("user_id", F.col("d").alias("pd")), ["user_id"], "d", "pd", 1, how).select("event_id", "user_id")


@query("SELECT a.event_id, a.user_id " + BAND.format("EXISTS"))
def band_semi(t):
    return _band(t, "left_semi")


@query("SELECT a.event_id, a.user_id " + BAND.format("NOT EXISTS"))
def band_anti(t):
    return _band(t, "left_anti")


@query("""SELECT event_id, near_id, CAST(gap AS BIGINT) AS gap FROM (
  SELECT a.event_id, b.event_id AS near_id, abs(date_diff('day', CAST(a.ts AS DATE), CAST(b.ts AS DATE))) AS gap,
         row_number() OVER (PARTITION BY a.event_id ORDER BY abs(date_diff('day', CAST(a.ts AS DATE), CAST(b.ts AS DATE))), CAST(b.ts AS DATE), b.event_id) AS n
  FROM events a JOIN events b ON a.user_id = b.user_id AND b.event_type = 'signup' AND abs(date_diff('day', CAST(a.ts AS DATE), CAST(b.ts AS DATE))) <= 14
  WHERE a.event_type = 'click') WHERE n = 1""")
def asof_nearest(t):
    e = t("events").select("user_id", "event_id", "event_type", day("ts").alias("d"))
    left = e.where("event_type = 'click'").select("user_id", "event_id", "d")
    right = e.where("event_type = 'signup'").select("user_id", F.col("event_id").alias("near_id"), F.col("d").alias("sd"))
    met = temporal.nearest(left, right, ["user_id"], ["event_id"], "d", "sd", 14, ["near_id"])
    return met.select("event_id", "near_id", long(F.abs(F.datediff("d", "sd"))).alias("gap"))


@query(f"""WITH {EPISODES_SQL}, spans AS (
  SELECT user_id, episode_no, min(CAST(ts AS DATE)) AS d0, max(CAST(ts AS DATE)) AS d1 FROM clustered GROUP BY user_id, episode_no HAVING count(*) >= 4)
SELECT s.user_id, CAST(s.episode_no AS BIGINT) AS episode_no, count(*) AS n_events, min(e.event_id) AS first_event
FROM spans s JOIN events e ON e.user_id = s.user_id AND CAST(e.ts AS DATE) BETWEEN s.d0 AND s.d1 GROUP BY s.user_id, s.episode_no""")
def interval_join_episode(t):
    events = t("events")
    spans = episodes(events).groupBy("user_id", "episode_no").agg(F.min(day("ts")).alias("d0"), F.max(day("ts")).alias("d1"), F.count("*").alias("n")).where("n >= 4")
    days = spans.withColumn("d", F.explode(F.sequence("d0", "d1")))  # an equi-join on the day: an episode lasts days, not years
    met = days.join(events.select("user_id", "event_id", day("ts").alias("d")), ["user_id", "d"])
    return met.groupBy("user_id", long("episode_no").alias("episode_no")).agg(F.count("*").alias("n_events"), F.min("event_id").alias("first_event"))


@query(f"""WITH {EPISODES_SQL}, bounds AS (SELECT user_id, episode_no, min(event_id) AS ref_start, max(event_id) AS ref_end, min(value) FILTER (WHERE event_type <> 'error') AS low FROM clustered GROUP BY 1, 2)
SELECT user_id, CAST(episode_no AS BIGINT) AS episode_no, ref_start, ref_end, coalesce(low, -1.0) AS low FROM bounds""")
def episode_bounds(t):
    low = F.min(F.when(F.col("event_type") != "error", F.col("value")))
    return episodes(t("events")).groupBy("user_id", long("episode_no").alias("episode_no")).agg(F.min("event_id").alias("ref_start"), F.max("event_id").alias("ref_end"), F.coalesce(low, F.lit(-1.0)).alias("low"))


@query("""WITH chunk AS (SELECT user_id, date_trunc('week', ts) AS w, min(CAST(ts AS DATE)) AS d0, max(CAST(ts AS DATE)) AS d1 FROM events GROUP BY 1, 2)
SELECT c.user_id, CAST(c.d0 AS VARCHAR) AS d0, count(*) AS n FROM chunk c JOIN events e ON e.user_id = c.user_id AND e.event_type = 'error'
AND CAST(e.ts AS DATE) BETWEEN c.d0 - 3 AND c.d1 + 3 GROUP BY 1, 2""")
def range_join_buffer(t):
    events = t("events").select("user_id", "event_type", "ts", day("ts").alias("d"))
    chunk = events.groupBy("user_id", F.date_trunc("week", "ts").alias("w")).agg(F.min("d").alias("d0"), F.max("d").alias("d1"))
    days = chunk.withColumn("d", F.explode(F.sequence(F.date_sub("d0", 3), F.date_add("d1", 3))))
    met = days.join(events.where("event_type = 'error'").select("user_id", "d"), ["user_id", "d"])
    return met.groupBy("user_id", F.col("d0").cast("string").alias("d0")).agg(F.count("*").alias("n"))


@query("""SELECT user_id, CAST(CAST(ts AS DATE) AS VARCHAR) AS day, event_type, event_id AS best, value FROM (
  SELECT *, row_number() OVER (PARTITION BY user_id, CAST(ts AS DATE), event_type ORDER BY value > 50 DESC, length(props) DESC, event_id) AS n FROM events) WHERE n = 1""")
def rollup_best_per_day(t):
    e = t("events").withColumn("day", day("ts"))
    best = temporal.top_per_group(e, ["user_id", "day", "event_type"], [(F.col("value") > 50).desc(), F.length("props").desc(), "event_id"], 1)
    return best.select("user_id", F.col("day").cast("string").alias("day"), "event_type", F.col("event_id").alias("best"), "value")


@query("""SELECT user_id, event_id, value, CAST(n AS BIGINT) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY value DESC, event_id) AS n FROM events) WHERE n <= 5""")
def topk_per_group(t):
    return temporal.top_per_group(t("events"), ["user_id"], [F.col("value").desc(), "event_id"], 5).select("user_id", "event_id", "value", long("rank").alias("rank"))


@query("""SELECT user_id, event_type, event_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY CAST(ts AS DATE) DESC, event_id) AS n FROM events) WHERE n = 1""")
def latest_mention(t):
    e = t("events").withColumn("d", day("ts"))
    return temporal.top_per_group(e, ["user_id", "event_type"], [F.col("d").desc(), "event_id"], 1).select("user_id", "event_type", "event_id")


@query("""SELECT user_id, event_id, 'E' || CAST(row_number() OVER (PARTITION BY user_id ORDER BY coalesce(CAST(CASE WHEN value > 5 THEN CAST(ts AS DATE) END AS VARCHAR), '9999-99-99'), event_id) AS VARCHAR) AS ref FROM events""")
def ref_numbering(t):
    e = t("events").withColumn("d", F.when(F.col("value") > 5, day("ts")))
    return graph.reference_numbers(e, ["user_id"], "d", "event_id").select("user_id", "event_id", "ref")


@query("""SELECT conv_id, CAST(island AS BIGINT) AS island, role, count(*) AS n, min(turn) AS first_turn FROM (
  SELECT *, sum(c) OVER (PARTITION BY conv_id ORDER BY turn, text ROWS UNBOUNDED PRECEDING) AS island FROM (
    SELECT *, CASE WHEN lag(role) OVER (PARTITION BY conv_id ORDER BY turn, text) = role THEN 0 ELSE 1 END AS c FROM conversations)) GROUP BY 1, 2, 3""")
def islands_merge(t):
    i = temporal.islands(t("conversations"), ["conv_id"], ["turn", "text"], "role")
    return i.groupBy("conv_id", long("island").alias("island"), "role").agg(F.count("*").alias("n"), F.min("turn").alias("first_turn"))


@query("""SELECT user_id, event_id, CAST(line AS BIGINT) AS line FROM (SELECT *, sum(CASE WHEN event_type = 'signup' THEN 1 ELSE 0 END) OVER w
 + sum(CASE WHEN event_type = 'error' THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS line
 FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING)) WHERE line IS NOT NULL""")
def line_numbering(t):
    along = W.partitionBy("user_id").orderBy(*EVENT_ORDER)
    one = lambda k: (F.col("event_type") == k).cast("int")
    line = F.sum(one("signup")).over(along.rowsBetween(W.unboundedPreceding, 0)) + F.sum(one("error")).over(along.rowsBetween(W.unboundedPreceding, -1))
    return t("events").withColumn("line", line).where("line is not null").select("user_id", "event_id", long("line").alias("line"))


@query("""SELECT user_id, string_agg(day || ': ' || line, ' | ' ORDER BY day) AS text FROM (
  SELECT user_id, CAST(CAST(ts AS DATE) AS VARCHAR) AS day, string_agg(event_type || '#' || CAST(event_id AS VARCHAR), ',' ORDER BY ts, event_id) AS line FROM events GROUP BY 1, 2) GROUP BY 1""")
def serialize_blocks(t):
    e = t("events").select("user_id", day("ts").cast("string").alias("day"), "ts", "event_id", F.concat_ws("#", "event_type", F.col("event_id").cast("string")).alias("s"))
    line = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ts", "event_id", "s"))), lambda x: x["s"]), ",")
    days = e.groupBy("user_id", "day").agg(F.concat_ws(": ", F.col("day"), line).alias("block"))
    return days.groupBy("user_id").agg(F.array_join(F.array_sort(F.collect_list("block")), " | ").alias("text"))


@query("""WITH RECURSIVE s AS (SELECT user_id, event_id, CAST(length(props) * 10 AS BIGINT) AS size, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS n FROM events),
p AS (SELECT user_id, n, size AS held, CAST(0 AS BIGINT) AS chunk_no, event_id FROM s WHERE n = 1
  UNION ALL SELECT s.user_id, s.n, CASE WHEN p.held + s.size <= 400 THEN p.held + s.size ELSE s.size END, CASE WHEN p.held + s.size <= 400 THEN p.chunk_no ELSE p.chunk_no + 1 END, s.event_id
  FROM p JOIN s ON s.user_id = p.user_id AND s.n = p.n + 1)
SELECT user_id, event_id, chunk_no FROM p""", name="greedy_chunks")
def greedy_chunks_query(t):
    e = t("events").select("user_id", "event_id", (F.length("props") * 10).alias("size"))
    return temporal.greedy_chunks(e, ["user_id"], ["event_id"], "size", 400).select("user_id", "event_id", long("chunk_no").alias("chunk_no"))


@query("""WITH d AS (SELECT user_id, CAST(ts AS DATE) AS d FROM events WHERE event_type = 'view' UNION SELECT user_id, CAST(ts AS DATE) FROM events WHERE event_type = 'click')
SELECT user_id, CAST(d AS VARCHAR) AS d FROM d""")
def union_dates(t):
    e = t("events").select("user_id", "event_type", day("ts").cast("string").alias("d"))
    return e.where("event_type = 'view'").select("user_id", "d").union(e.where("event_type = 'click'").select("user_id", "d")).distinct()


@query("""SELECT user_id, CAST(d AS VARCHAR) AS d FROM (SELECT user_id, CAST(ts AS DATE) AS d FROM events WHERE event_type = 'view' EXCEPT SELECT user_id, CAST(ts AS DATE) FROM events WHERE event_type = 'click')""")
def except_dates(t):
    e = t("events").select("user_id", "event_type", day("ts").cast("string").alias("d"))
    return e.where("event_type = 'view'").select("user_id", "d").subtract(e.where("event_type = 'click'").select("user_id", "d"))


@query("""SELECT l_partkey FROM lineitem WHERE l_returnflag = 'A' INTERSECT SELECT l_partkey FROM lineitem WHERE l_returnflag = 'R'""")
def intersect_refs(t):
    part = lambda f: t("lineitem").where(F.col("l_returnflag") == f).select("l_partkey")
    return part("A").intersect(part("R"))


@query(f"""WITH {EPISODES_SQL}, e AS (SELECT user_id, episode_no, min(ts) AS s, max(ts) AS f, count(*) AS n FROM clustered GROUP BY 1, 2),
v AS (SELECT *, lag(f) OVER (PARTITION BY user_id ORDER BY episode_no) AS before FROM e)
SELECT user_id, CAST(episode_no AS BIGINT) AS episode_no, 'short' AS problem FROM v WHERE n < 2 UNION ALL SELECT user_id, CAST(episode_no AS BIGINT), 'overlap' FROM v WHERE s < before
UNION ALL SELECT user_id, CAST(episode_no AS BIGINT), 'long' FROM v WHERE date_sub('hour', s, f) > 48""")
def episode_validation(t):
    e = episodes(t("events")).groupBy("user_id", "episode_no").agg(F.min("ts").alias("s"), F.max("ts").alias("f"), F.count("*").alias("n"))
    v = e.withColumn("before", F.lag("f").over(W.partitionBy("user_id").orderBy("episode_no")))
    found = F.array_compact(F.array(F.when(F.col("n") < 2, "short"), F.when(F.col("s") < F.col("before"), "overlap"), F.when(F.expr("timestampdiff(HOUR, s, f) > 48"), "long")))
    return v.select("user_id", long("episode_no").alias("episode_no"), F.explode(found).alias("problem"))


@query("""SELECT user_id, event_type, event_id, CAST(rank AS BIGINT) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id) AS rank FROM events
WHERE ts >= TIMESTAMP '2024-01-20') WHERE rank <= 3""")
def recent_by_class(t):
    e = t("events").where("ts >= timestamp_ntz'2024-01-20'")
    return temporal.top_per_group(e, ["user_id", "event_type"], [F.col("ts").desc(), "event_id"], 3).select("user_id", "event_type", "event_id", long("rank").alias("rank"))


@query("""SELECT user_id, event_id, CAST(date_diff('day', CAST(ts AS DATE), DATE '2024-02-01') AS BIGINT) AS days FROM events""")
def day_gap(t):
    return t("events").select("user_id", "event_id", long(F.datediff(F.lit("2024-02-01").cast("date"), day("ts"))).alias("days"))


@query("""SELECT event_id, CAST(row_number() OVER (PARTITION BY user_id ORDER BY CAST(ts AS DATE), list_position(['purchase','signup','click','view','error'], event_type), event_id) AS BIGINT) AS place FROM events""")
def precedence_sort(t):
    rank = F.array_position(F.array(*map(F.lit, ["purchase", "signup", "click", "view", "error"])), F.col("event_type"))
    return t("events").select("event_id", long(F.row_number().over(W.partitionBy("user_id").orderBy(day("ts"), rank, "event_id"))).alias("place"))


@query("""WITH r AS (SELECT user_id, event_id, row_number() OVER w AS n, count(*) OVER (PARTITION BY user_id) AS total FROM events WINDOW w AS (PARTITION BY user_id ORDER BY value DESC, event_id))
SELECT user_id, event_id, 'top' AS part FROM r WHERE n <= 7 UNION ALL SELECT user_id, event_id, 'mid' FROM r WHERE total > 10 AND n > total // 2 - 1 AND n <= total // 2 + 2""")
def top_plus_mid(t):
    order = W.partitionBy("user_id").orderBy(F.col("value").desc(), "event_id")
    r = t("events").withColumns({"n": F.row_number().over(order), "total": F.count("*").over(W.partitionBy("user_id"))})
    middle = F.floor(F.col("total") / 2)
    held = F.array_compact(F.array(F.when(F.col("n") <= 7, "top"), F.when((F.col("total") > 10) & (F.col("n") > middle - 1) & (F.col("n") <= middle + 2), "mid")))
    return r.select("user_id", "event_id", F.explode(held).alias("part"))


@query("""SELECT event_id, CAST((row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1) // 20 AS BIGINT) AS batch FROM events""")
def batch_assign(t):
    n = F.row_number().over(W.partitionBy("user_id").orderBy("event_id"))
    return t("events").select("event_id", long(F.floor((n - 1) / 20)).alias("batch"))
