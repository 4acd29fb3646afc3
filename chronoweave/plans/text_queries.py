"""Keyword search, tokens, ranking and scalar text rules over documents, pages and parts."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from chronoweave.functions import clinical, text
from chronoweave.operators import similarity, temporal
from chronoweave.plans.registry import long, query

KEYWORDS = ["license", "theand", "stupid", "password"]
VALUES = "(VALUES " + ", ".join(f"({i}, '{k}')" for i, k in enumerate(KEYWORDS)) + ") AS k(kw_seq, keyword)"
HITS = f"hits AS (SELECT d.doc_id, k.kw_seq, k.keyword, strpos(lower(d.text), k.keyword) AS pos, d.text FROM documents d, {VALUES} WHERE strpos(lower(d.text), k.keyword) > 0)"
SNIPPET = """CASE WHEN pos - 40 > 1 THEN '...' ELSE '' END || substr(text, greatest(pos - 40, 1), least(pos + length(keyword) - 1 + 40, length(text)) - greatest(pos - 40, 1) + 1)
 || CASE WHEN pos + length(keyword) - 1 + 40 < length(text) THEN '...' ELSE '' END"""


def hits(t):
    return text.keyword_hits(t("documents").select("doc_id", "source", "text"), "text", KEYWORDS, around=40)


@query(f"WITH {HITS} SELECT doc_id, keyword, CAST(pos AS BIGINT) AS pos, {SNIPPET} AS snippet FROM hits")
def kw_search_snippet(t):
    return hits(t).select("doc_id", "keyword", long("at").alias("pos"), "snippet")


@query(f"""WITH {HITS} SELECT keyword, count(*) AS n, max(doc_id) AS latest FROM hits GROUP BY keyword""")
def per_keyword_latest(t):
    return hits(t).groupBy("keyword").agg(F.count("*").alias("n"), F.max("doc_id").alias("latest"))


@query(f"""WITH {HITS} SELECT source, count(*) AS n, max(doc_id) AS latest, count(DISTINCT keyword) AS n_keywords FROM hits JOIN documents USING (doc_id) GROUP BY source""")
def mentions_summary(t):
    return hits(t).groupBy("source").agg(F.count("*").alias("n"), F.max("doc_id").alias("latest"), F.countDistinct("keyword").alias("n_keywords"))


@query(f"""WITH {HITS} SELECT doc_id, arg_min(keyword, kw_seq) AS keyword FROM hits GROUP BY doc_id""")
def first_kw_per_key(t):
    return hits(t).groupBy("doc_id").agg(F.min_by("keyword", "kw_seq").alias("keyword"))


@query(f"""WITH {HITS}, s AS (SELECT doc_id, keyword, kw_seq, {SNIPPET} AS snippet FROM hits)
SELECT doc_id, keyword, CAST(length(snippet) AS BIGINT) AS n FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY length(snippet) DESC, kw_seq) AS n FROM s) WHERE n = 1""")
def longest_per_key(t):
    best = temporal.top_per_group(hits(t), ["doc_id"], [F.length("snippet").desc(), "kw_seq"], 1)
    return best.select("doc_id", "keyword", long(F.length("snippet")).alias("n"))


@query("""SELECT doc_id, coalesce(list_filter(string_split_regex(text, '\\.\\s+'), lambda s: strpos(lower(s), 'stupid') > 0)[1], substr(text, 1, 200)) AS sentence FROM documents""")
def kw_sentence(t):
    return t("documents").select("doc_id", text.sentence_with(F.col("text"), "stupid").alias("sentence"))


@query("""SELECT doc_id, CAST(i AS BIGINT) AS chunk_no, substr(text, CAST(i * 500 + 1 AS BIGINT), 500) AS chunk FROM (SELECT doc_id, text, unnest(range(CAST(ceil(length(text) / 500.0) AS BIGINT))) AS i FROM documents)""")
def chunk_text(t):
    return text.chunks(t("documents").select("doc_id", "text"), "text", 500).select("doc_id", long("chunk_no").alias("chunk_no"), "chunk")


@query("""SELECT doc_id, CAST(len(x) AS BIGINT) AS n, CAST(len(list_distinct(x)) AS BIGINT) AS n_distinct FROM (SELECT doc_id, regexp_extract_all(lower(text), '[a-z0-9]+') AS x FROM documents)""")
def tokenize_count(t):
    d = t("documents").select("doc_id", text.tokens(F.col("text")).alias("x"))
    return d.select("doc_id", long(F.size("x")).alias("n"), long(F.size(F.array_distinct("x"))).alias("n_distinct"))


BM25_SQL = """w AS (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[a-z0-9]+')) AS word FROM documents),
tf AS (SELECT doc_id, word, count(*) AS tf FROM w GROUP BY 1, 2), dl AS (SELECT doc_id, CAST(len(regexp_extract_all(lower(text), '[a-z0-9]+')) AS DOUBLE) AS dl FROM documents),
k AS (SELECT count(*) AS n, avg(dl) AS avgdl FROM dl), df AS (SELECT word, ln((any_value(k.n) - count(*) + 0.5) / (count(*) + 0.5)) AS idf FROM tf, k GROUP BY word),
idf AS (SELECT word, CASE WHEN idf < 0 THEN 0.25 * (SELECT avg(idf) FROM df) ELSE idf END AS idf FROM df),
q AS (SELECT item_id, word, count(*) AS qf FROM (SELECT item_id, unnest(regexp_extract_all(lower(text), '[a-z0-9]+')) AS word FROM benchmark) GROUP BY 1, 2),
scored AS (SELECT item_id, doc_id, sum(qf * idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avgdl))) AS score FROM q JOIN idf USING (word) JOIN tf USING (word) JOIN dl USING (doc_id), k GROUP BY 1, 2),
ranked AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY round(score, 6) DESC, doc_id) AS rank FROM scored)"""


def _ranked(t, k):
    words = lambda table, key: t(table).select(key, text.tokens(F.col("text")).alias("x"))
    scored = similarity.bm25(words("documents", "doc_id"), words("benchmark", "item_id"), doc="doc_id", query="item_id", tokens="x")
    return temporal.top_per_group(scored.withColumn("score", F.round("score", 6)), ["item_id"], [F.col("score").desc(), "doc_id"], k)


@query(f"WITH {BM25_SQL} SELECT item_id, doc_id, round(score, 6) AS score, rank FROM ranked WHERE rank <= 5")
def bm25_topk(t):
    return _ranked(t, 5).select("item_id", "doc_id", "score", long("rank").alias("rank"))


@query(f"""WITH {BM25_SQL}, p AS (SELECT r.item_id, r.doc_id, r.rank, sum(dl) OVER (PARTITION BY item_id ORDER BY rank ROWS UNBOUNDED PRECEDING) AS running FROM ranked r JOIN dl USING (doc_id) WHERE rank <= 20)
SELECT item_id, doc_id, rank, CAST(running AS BIGINT) AS running FROM p WHERE running <= 3000""")
def budget_pack(t):
    sizes = t("documents").select("doc_id", long(F.size(text.tokens(F.col("text")))).alias("dl"))
    packed = similarity.pack(_ranked(t, 20).join(sizes, "doc_id"), ["item_id"], ["rank"], "dl", 3000)
    return packed.select("item_id", "doc_id", long("rank").alias("rank"), long("running").alias("running"))


@query("""SELECT page_id, regexp_extract(html, '<title>([^<]*)</title>', 1) AS title, CAST(len(regexp_extract_all(html, '<p>')) AS BIGINT) AS n_paragraphs FROM pages""")
def html_title_extract(t):
    p = t("pages")
    return p.select("page_id", F.regexp_extract("html", "<title>([^<]*)</title>", 1).alias("title"), long(F.regexp_count("html", F.lit("<p>"))).alias("n_paragraphs"))


@query("""SELECT p_partkey, CASE WHEN p_name LIKE '%ring%' THEN 'round' WHEN p_name LIKE '%bolt%' OR p_name LIKE '%widget%' THEN 'fixing' WHEN p_type = 'PROMO' THEN 'promo' ELSE 'other' END AS class FROM part""")
def modality_case(t):
    name = F.col("p_name")
    return t("part").select("p_partkey", F.when(name.contains("ring"), "round").when(name.contains("bolt") | name.contains("widget"), "fixing").when(F.col("p_type") == "PROMO", "promo").otherwise("other").alias("class"))


@query("""SELECT doc_id, CASE WHEN len(x) > 0 THEN array_to_string(x, '/') ELSE 'unspecified' END AS labels FROM (
 SELECT doc_id, list_filter(['stupid','moron','trash','license','password','the'], lambda k: strpos(lower(text), k) > 0) AS x FROM documents)""")
def multi_label(t):
    return t("documents").select("doc_id", text.labels_in(F.col("text"), ["stupid", "moron", "trash", "license", "password", "the"]).alias("labels"))


@query("""SELECT doc_id FROM documents WHERE lang = 'en' AND (strpos(lower(text), 'license') > 0 OR strpos(lower(text), 'theand') > 0) AND strpos(text, '|') = 0 AND NOT (source = 'src1')""")
def report_predicate(t):
    low = F.lower("text")
    return t("documents").where((F.col("lang") == "en") & (low.contains("license") | low.contains("theand")) & ~F.col("text").contains("|") & (F.col("source") != "src1")).select("doc_id")


@query("""SELECT doc_id, regexp_matches(text, '(?i)\\bth[aeo]\\b') AS a, regexp_matches(text, '(?i)\\bon[0-3a-e]\\b') AS b, regexp_matches(text, '[A-Z]{4,}') AS c FROM documents""")
def regex_components(t):
    return t("documents").select("doc_id", F.col("text").rlike(r"(?i)\bth[aeo]\b").alias("a"), F.col("text").rlike(r"(?i)\bon[0-3a-e]\b").alias("b"), F.col("text").rlike("[A-Z]{4,}").alias("c"))


@query("""SELECT doc_id, word FROM (SELECT doc_id, regexp_extract(lower(text), '\\b([a-z]{3,}(?:ation|ering))\\b', 1) AS word FROM documents WHERE lang = 'en') WHERE word <> '' AND word NOT IN ('hation', 'tering')""")
def regex_first_match(t):
    found = t("documents").where("lang = 'en'").select("doc_id", F.regexp_extract(F.lower("text"), r"\b([a-z]{3,}(?:ation|ering))\b", 1).alias("word"))
    return found.where("word <> '' and word not in ('hation', 'tering')")


@query("""SELECT doc_id FROM documents WHERE lang = 'de' OR source = 'src2' OR strpos(lower(text), 'stupid') > 0""")
def or_predicate(t):
    return t("documents").where((F.col("lang") == "de") | (F.col("source") == "src2") | F.lower("text").contains("stupid")).select("doc_id")


@query("""SELECT doc_id, right(text, 100) AS tail FROM documents""")
def tail_text(t):
    return t("documents").select("doc_id", text.tail(F.col("text"), 100).alias("tail"))


@query("""SELECT doc_id, CASE WHEN length(text) > 150 THEN substr(text, 1, 150) || '...' ELSE text END AS short FROM documents""")
def truncate(t):
    return t("documents").select("doc_id", text.truncated(F.col("text"), 150).alias("short"))


@query("""SELECT doc_id, md5(trim(regexp_replace(lower(text), '[^a-z0-9]+', ' ', 'g'))) AS norm FROM documents""")
def normalize_text(t):
    return t("documents").select("doc_id", F.md5(text.normalized(F.col("text"))).alias("norm"))


@query("""SELECT doc_id, list_aggregate(x, 'min') AS lo, list_aggregate(x, 'max') AS hi FROM (SELECT doc_id, regexp_extract_all(text, '[0-9]{2,}') AS x FROM documents) WHERE len(x) > 0""")
def array_minmax(t):
    d = t("documents").select("doc_id", F.regexp_extract_all("text", F.lit("([0-9]{2,})"), F.lit(1)).alias("x")).where(F.size("x") > 0)
    return d.select("doc_id", F.array_min("x").alias("lo"), F.array_max("x").alias("hi"))


@query("""WITH s AS (SELECT o_orderkey, 'seen on ' || strftime(o_orderdate, '%-m/%-d/%Y') || ' by' AS note FROM orders)
SELECT o_orderkey, regexp_extract(note, '(\\d{1,2})/(\\d{1,2})/(\\d{4})', 3) || '-' || lpad(regexp_extract(note, '(\\d{1,2})/(\\d{1,2})/(\\d{4})', 1), 2, '0') || '-' || lpad(regexp_extract(note, '(\\d{1,2})/(\\d{1,2})/(\\d{4})', 2), 2, '0') AS iso FROM s""")
def us_date_to_iso(t):
    note = F.concat(F.lit("seen on "), F.date_format("o_orderdate", "M/d/yyyy"), F.lit(" by"))
    return t("orders").select("o_orderkey", text.us_date(note).alias("iso"))


@query("""SELECT o_orderkey, CAST(CAST(o_orderdate AS DATE) AS VARCHAR) AS d FROM orders""")
def multi_format_dates(t):
    k = F.col("o_orderkey") % 4
    shown = F.when(k == 0, F.date_format("o_orderdate", "yyyy-MM-dd")).when(k == 1, F.date_format("o_orderdate", "M/d/yyyy")).when(k == 2, F.date_format("o_orderdate", "yyyy/M/d")).otherwise(F.date_format("o_orderdate", "M-d-yyyy"))
    return t("orders").select("o_orderkey", text.any_date(shown).cast("string").alias("d"))


@query("""SELECT event_id, CASE WHEN value > 100 THEN 'high' WHEN value < 5 THEN 'low' ELSE 'normal' END AS direction, round(value, 6) AS value FROM events""")
def parse_lab(t):
    mark = F.when(F.col("value") > 100, "↑").when(F.col("value") < 5, "↓").otherwise("")
    got = clinical.lab_value(F.concat(F.col("value").cast("string"), F.lit(" "), mark))
    return t("events").select("event_id", got["direction"].alias("direction"), F.round(got["value"], 6).alias("value"))


@query("""SELECT doc_id, CASE WHEN strpos(lower(text), 'license') > 0 THEN 'licensed' WHEN strpos(lower(text), 'stupid') > 0 OR strpos(lower(text), 'moron') > 0 THEN 'rude' WHEN strpos(text, '|') > 0 THEN 'table' ELSE 'plain' END AS class FROM documents""")
def keyword_class(t):
    return t("documents").select("doc_id", text.first_class(F.col("text"), [("licensed", ["license"]), ("rude", ["stupid", "moron"]), ("table", ["|"])], "plain").alias("class"))


@query("""SELECT p_partkey, CASE WHEN lower(trim(p_type)) = 'economy' THEN 'cheap' WHEN lower(trim(p_type)) IN ('small', 'medium') THEN 'common' ELSE lower(trim(p_type)) END AS kind FROM part""")
def normalize_map(t):
    return t("part").select("p_partkey", clinical.mapped(F.col("p_type"), {"economy": "cheap", "small": "common", "medium": "common"}).alias("kind"))


@query("""SELECT o_orderkey, CASE WHEN y > 0 AND y < 120 THEN round(y, 6) END AS years FROM (SELECT o_orderkey, date_diff('day', CAST(o_orderdate AS DATE), DATE '1999-06-30') / 365.25 AS y FROM orders)""")
def age_calc(t):
    years = F.datediff(F.lit("1999-06-30").cast("date"), F.col("o_orderdate").cast("date")) / F.lit(365.25)
    return t("orders").select("o_orderkey", F.when((years > 0) & (years < 120), F.round(years, 6)).alias("years"))


@query("""SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, 'k=' || json_extract_string(props, '$.k') AS shown FROM events""")
def struct_extract(t):
    k = F.from_json("props", "k bigint")["k"]
    return t("events").select("event_id", k.alias("k"), F.concat(F.lit("k="), k.cast("string")).alias("shown"))


@query("""SELECT event_id, 'k' AS name, CAST(json_extract_string(props, '$.k') AS DOUBLE) AS value, 'measure_' || substr(md5(CAST(event_id AS VARCHAR) || '_k'), 1, 16) AS node_id FROM events""")
def explode_map(t):
    e = t("events").select("event_id", F.explode(F.from_json("props", "map<string,double>")).alias("name", "value"))
    return e.select("event_id", "name", "value", F.concat(F.lit("measure_"), F.substring(F.md5(F.concat_ws("_", F.col("event_id").cast("string"), "name")), 1, 16)).alias("node_id"))


@query("""SELECT user_id, event_id, CAST(json_extract_string(props, '$.k') AS DOUBLE) AS value FROM events WHERE ts >= TIMESTAMP '2024-01-10' AND ts < TIMESTAMP '2024-01-20' AND CAST(json_extract_string(props, '$.k') AS DOUBLE) > 50""")
def range_explode(t):
    e = t("events").where("ts >= timestamp_ntz'2024-01-10' and ts < timestamp_ntz'2024-01-20'")
    return e.select("user_id", "event_id", F.explode(F.from_json("props", "map<string,double>")).alias("name", "value")).where("name = 'k' and value > 50").drop("name")


@query("""SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) * 2 AS twice, 'k' AS names FROM events WHERE CAST(json_extract_string(props, '$.k') AS BIGINT) >= 10""")
def map_hof(t):
    m = F.map_filter(F.from_json("props", "map<string,bigint>"), lambda _, v: v >= 10)
    e = t("events").select("event_id", F.transform_values(m, lambda _, v: v * 2).alias("m")).where(F.size("m") > 0)
    return e.select("event_id", F.try_element_at("m", F.lit("k")).alias("twice"), F.array_join(F.map_keys("m"), ",").alias("names"))


@query("""SELECT event_id, 'K_SECTION' AS section, json_extract_string(props, '$.k') AS value FROM events""")
def map_keys_norm(t):
    m = F.transform_keys(F.from_json("props", "map<string,string>"), lambda k, _: F.concat(F.upper(F.trim(k)), F.lit("_SECTION")))
    return t("events").select("event_id", F.explode(m).alias("section", "value"))


@query("""SELECT event_id, md5(CAST(CAST(ts AS DATE) AS VARCHAR) || '|' || event_type || '|' || 'k=' || json_extract_string(props, '$.k')) AS signature FROM events""")
def signature_md5(t):
    pairs = F.array_sort(F.transform(F.map_entries(F.from_json("props", "map<string,string>")), lambda e: F.concat_ws("=", e["key"], e["value"])))
    return t("events").select("event_id", F.md5(F.concat_ws("|", F.col("ts").cast("date").cast("string"), "event_type", F.array_join(pairs, ","))).alias("signature"))


@query("""SELECT event_id, round(1 / (1 + exp(-(least(greatest(value, 1), 60) - 30) / 10)), 6) AS p FROM events""")
def sigmoid_clip(t):
    clipped = F.least(F.greatest(F.col("value"), F.lit(1.0)), F.lit(60.0))
    return t("events").select("event_id", F.round(1 / (1 + F.exp(-(clipped - 30) / 10)), 6).alias("p"))


@query("""SELECT user_id, CAST(count(*) AS BIGINT) AS n, string_agg(k, ';' ORDER BY seq) AS marks FROM (SELECT user_id, min(event_id) AS seq, json_extract_string(props, '$.k') AS k FROM events WHERE value > 50 GROUP BY user_id, k) GROUP BY user_id""")
def abnormal_map(t):
    e = t("events").where("value > 50").select("user_id", "event_id", F.from_json("props", "k string")["k"].alias("k"))
    firsts = e.groupBy("user_id", "k").agg(F.min("event_id").alias("seq"))
    return firsts.groupBy("user_id").agg(F.count("*").alias("n"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seq", "k"))), lambda x: x["k"]), ";").alias("marks"))


@query("""SELECT c_custkey, c_name || ' | ' || c_mktsegment || ' | ' || CAST(c_nationkey AS VARCHAR) AS line FROM customer""")
def format_row(t):
    return t("customer").select("c_custkey", F.concat_ws(" | ", "c_name", "c_mktsegment", F.col("c_nationkey").cast("string")).alias("line"))


@query("""WITH s(kind, term) AS (VALUES ('purchase', 'stupid'), ('error', 'moron'), ('click', 'license')),
h AS (SELECT kind, doc_id, len(regexp_extract_all(lower(text), '\\b' || term || '[a-z]*')) AS n FROM documents, s)
SELECT kind, doc_id, CAST(n AS BIGINT) AS n, round(least(1.0, n / 3.0), 6) AS confidence FROM h WHERE n > 0""")
def strategy_retrieval(t):
    table = F.array(*[F.struct(F.lit(k).alias("kind"), F.lit(x).alias("term")) for k, x in (("purchase", "stupid"), ("error", "moron"), ("click", "license"))])
    d = t("documents").select("doc_id", F.lower("text").alias("low")).where(F.col("low").rlike("stupid|moron|license")).select("*", F.explode(table).alias("s"))
    n = F.size(F.regexp_extract_all("low", F.concat(F.lit(r"\b("), F.col("s.term"), F.lit("[a-z]*)")), F.lit(1)))
    return d.select(F.col("s.kind").alias("kind"), "doc_id", long(n).alias("n")).where("n > 0").withColumn("confidence", F.round(F.least(F.lit(1.0), F.col("n") / 3.0), 6))


@query("""SELECT doc_id, coalesce(CASE WHEN strpos(lower(text), 'license') > 0 THEN 'license' END, CASE WHEN n_chars > 2000 THEN 'long' END, lang) AS origin FROM documents""")
def priority_coalesce(t):
    return t("documents").select("doc_id", F.coalesce(F.when(F.lower("text").contains("license"), "license"), F.when(F.col("n_chars") > 2000, "long"), F.col("lang")).alias("origin"))


@query("""SELECT lang, doc_id FROM (SELECT lang, doc_id, row_number() OVER (PARTITION BY lang ORDER BY n_chars DESC, doc_id) AS n FROM documents WHERE strpos(text, '|') = 0) WHERE n = 1""")
def latest_report(t):
    return temporal.top_per_group(t("documents").where(~F.col("text").contains("|")), ["lang"], [F.col("n_chars").desc(), "doc_id"], 1).select("lang", "doc_id")


@query("""WITH r AS (SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY n_chars DESC, doc_id) AS n FROM documents WHERE lang = 'en') SELECT source, string_agg(CAST(doc_id AS VARCHAR), ',' ORDER BY n) AS docs FROM r WHERE n <= 20 GROUP BY source""")
def evidence_caps(t):
    r = t("documents").where("lang = 'en'").withColumn("n", F.row_number().over(W.partitionBy("source").orderBy(F.col("n_chars").desc(), "doc_id"))).where("n <= 20")
    return r.groupBy("source").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n", F.col("doc_id").cast("string").alias("d")))), lambda x: x["d"]), ",").alias("docs"))
