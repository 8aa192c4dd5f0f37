"""The registered queries: library operators bound to the given tables, and their SQL.

Every query runs over whole tables. Sums of doubles are of values rounded to whole cents
first, so that they don't depend on the order of rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import errors, predicates, scalars
from ..operators import aggregates, classify, disc, folds, joins, rank
from ..streaming import events as streams

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def cents(c: str):
    return F.round(F.col(c) * 100).cast("bigint")


@query("""
SELECT path, ext FROM (
  SELECT p.path, lower(regexp_extract(last, '^.+[.]([^.]*)$', 1)) AS ext,
         row_number() OVER (PARTITION BY canonical ORDER BY p.path) AS rn
  FROM (SELECT url AS path, regexp_replace(url, '[?#].*$', '') AS canonical, list_last(string_split(regexp_replace(url, '[?#].*$', ''), '/')) AS last FROM pages) p
  WHERE last NOT LIKE '.tmp%' AND path LIKE 'http%')
WHERE rn = 1 ORDER BY string_split(path, '/')
""")
def scan_filter_dedup_sort(spark, sf_dir):
    p = table(spark, sf_dir, "pages").select(F.col("url").alias("path"), F.regexp_replace("url", "[?#].*$", "").alias("canonical"))
    p = p.where(~scalars.file_name(F.col("canonical")).startswith(".tmp") & F.col("path").startswith("http"))
    p = joins.first_of(p, ["canonical"], ["path"])
    return p.select("path", scalars.ext_lower(F.col("canonical")).alias("ext")).orderBy(F.split("path", "/"))


GATE_SQL = """
SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber,
  CASE WHEN l_returnflag = 'R' AND l_discount > 0.09 THEN 'probe-error'
       WHEN l_quantity > 0 AND l_quantity < 5 THEN 'skip'
       WHEN l_returnflag = 'A' AND l_linestatus = 'F' AND l_discount <= 0.05 THEN 'skip-silent'
       WHEN l_tax >= 0.07 THEN 'skip'
       WHEN l_linenumber = 1 THEN 'resumed'
       WHEN l_suppkey % 10 = 0 THEN 'skip'
       WHEN l_partkey % 7 = 0 THEN 'skip'
       ELSE 'transcode' END AS outcome,
  CASE WHEN l_returnflag = 'R' AND l_discount > 0.09 THEN 'probe failed'
       WHEN l_quantity > 0 AND l_quantity < 5 THEN 'duration too short'
       WHEN l_returnflag = 'A' AND l_linestatus = 'F' AND l_discount <= 0.05 THEN NULL
       WHEN l_tax >= 0.07 THEN '10-bit source, but the device has no 10-bit encoder'
       WHEN l_linenumber = 1 THEN NULL
       WHEN l_suppkey % 10 = 0 THEN 'destination is not writable'
       WHEN l_partkey % 7 = 0 THEN 'ambiguous primary audio' END AS reason,
  CAST(round(l_extendedprice * 100) AS BIGINT) AS size
FROM lineitem
"""


@query(GATE_SQL)
def classify_gate_lineitem(spark, sf_dir):
    l = table(spark, sf_dir, "lineitem")
    gate = classify.outcome(
        error=F.when((F.col("l_returnflag") == "R") & (F.col("l_discount") > 0.09), "probe failed"),
        too_short=predicates.is_too_short(F.col("l_quantity"), 5.0),
        meets_target=(F.col("l_returnflag") == "A") & (F.col("l_linestatus") == "F") & (F.col("l_discount") <= 0.05),
        needs_10bit=F.col("l_tax") >= 0.07,
        resumed=F.col("l_linenumber") == 1,
        unwritable=F.col("l_suppkey") % 10 == 0,
        ambiguous=F.col("l_partkey") % 7 == 0,
    )
    return l.withColumn("g", gate).select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "g.outcome", "g.reason", cents("l_extendedprice").alias("size"))


@query(f"SELECT outcome, count(*) AS n, CAST(sum(size) AS BIGINT) AS bytes FROM ({GATE_SQL}) GROUP BY outcome")
def outcome_counts(spark, sf_dir):
    return classify.counts(classify_gate_lineitem(spark, sf_dir), size_col="size")


@query(f"SELECT count(*) FILTER (outcome IN ('skip', 'skip-silent')) AS skipped, count(*) FILTER (outcome = 'resumed') AS resumed, count(*) FILTER (outcome = 'probe-error') AS errors, count(*) FILTER (outcome = 'transcode') AS to_transcode FROM ({GATE_SQL})")
def partition_counters(spark, sf_dir):
    return classify.partition(classify_gate_lineitem(spark, sf_dir))


@query("SELECT p_partkey, p_type LIKE 'ECONOMY%' AND p_size <= 25 AND p_retailprice <= 1500 AND p_partkey % 1000 <= 800 AS meets FROM part")
def meets_target_part(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    codec = F.when(F.col("p_type").startswith("ECONOMY"), "hevc").otherwise("other")
    return p.select("p_partkey", predicates.meets_target(codec, F.col("p_size"), F.col("p_retailprice"), F.col("p_partkey") % 1000, max_width=25, max_height=1500, max_kbps=800).alias("meets"))


def _primary_sql(sign: str, frm: str) -> str:
    return f"""
WITH s AS (SELECT l_orderkey, (l_linenumber::BIGINT * 1000000 + l_partkey) * 100000 + l_suppkey AS idx, l_quantity AS c, round(l_extendedprice, 2) AS b, l_returnflag = 'R' AS x, l_linestatus = 'F' AS d, {sign} AS y FROM {frm}),
w AS (SELECT *, count(*) OVER (PARTITION BY l_orderkey) AS n, min(x::INT) OVER (PARTITION BY l_orderkey) = 1 AS talk FROM s),
p AS (SELECT *, row_number() OVER o AS r, lead(c) OVER o AS c2, lead(b) OVER o AS b2 FROM w WHERE NOT x OR talk OR n = 1
      WINDOW o AS (PARTITION BY l_orderkey ORDER BY CASE WHEN y < 1995 THEN c ELSE -c END, b DESC, d DESC, idx))
SELECT l_orderkey, idx AS primary_index, n AS n_streams,
  CASE WHEN n = 1 THEN false ELSE talk OR coalesce(c = c2 AND b = b2, false) END AS ambiguous,
  CASE WHEN n = 1 THEN NULL WHEN talk THEN '{rank.ALL_COMMENTARY}' WHEN c = c2 AND b = b2 THEN '{rank.TIED}' END AS reason
FROM p WHERE r = 1"""


def _by_order(spark, sf_dir) -> DataFrame:
    l = table(spark, sf_dir, "lineitem")
    return rank.dealt(l, ["l_orderkey"], l.count())


def _primary(l: DataFrame, year) -> DataFrame:
    idx = (F.col("l_linenumber").cast("bigint") * 1000000 + F.col("l_partkey")) * 100000 + F.col("l_suppkey")
    return rank.pick_primary(l, ["l_orderkey"], idx=idx, channels=F.col("l_quantity"), bitrate=F.round("l_extendedprice", 2), commentary=F.col("l_returnflag") == "R", default=F.col("l_linestatus") == "F", year=year, era=1995)


@query(_primary_sql("2000", "lineitem"))
def primary_pick_per_order(spark, sf_dir):
    return _primary(_by_order(spark, sf_dir), None)


@query(_primary_sql("year(o_orderdate)", "lineitem JOIN orders ON l_orderkey = o_orderkey"))
def primary_pick_era_flip(spark, sf_dir):
    l = _by_order(spark, sf_dir).join(table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_orderdate"), "l_orderkey")
    return _primary(l, F.year("o_orderdate"))


SETS_SQL = """
SELECT l_returnflag, title_set, set_size, n_files, set_size >= floor(max(set_size) OVER (PARTITION BY l_returnflag) * 80 / 100) AS is_main
FROM (SELECT l_returnflag, CAST(l_suppkey AS VARCHAR) AS title_set, CAST(sum(CAST(round(l_extendedprice * 100) AS BIGINT)) AS BIGINT) AS set_size, count(*) AS n_files FROM lineitem GROUP BY ALL)
"""


@query(SETS_SQL)
def main_set_80pct(spark, sf_dir):
    return disc.title_sets(table(spark, sf_dir, "lineitem"), ["l_returnflag"], F.col("l_suppkey").cast("string"), cents("l_extendedprice"))


@query(f"SELECT l_returnflag, title_set, 'title' || CASE WHEN rn < 10 THEN '0' ELSE '' END || left(CAST(rn AS VARCHAR), 2) AS title FROM (SELECT *, row_number() OVER (PARTITION BY l_returnflag ORDER BY title_set) AS rn FROM ({SETS_SQL}) WHERE is_main)")
def title_numbering(spark, sf_dir):
    return disc.numbered(main_set_80pct(spark, sf_dir).where("is_main"), ["l_returnflag"], ["title_set"]).select("l_returnflag", "title_set", "title")


@query("SELECT p_partkey, p_brand, CASE WHEN size >= floor(max(size) OVER (PARTITION BY p_brand) / 4) THEN 'main' ELSE 'extra' END AS role FROM (SELECT *, CAST(round(p_retailprice * 100) AS BIGINT) * p_size AS size FROM part)")
def main_feature_25pct(spark, sf_dir):
    p = table(spark, sf_dir, "part").withColumn("size", cents("p_retailprice") * F.col("p_size"))
    p = disc.share_of_largest(p, ["p_brand"], F.col("size"), 1, 4)
    return p.select("p_partkey", "p_brand", F.when(F.col("is_main"), "main").otherwise("extra").alias("role"))


@query("""
WITH s AS (SELECT *, l_discount >= 0.095 AS failed FROM lineitem),
g AS (SELECT l_orderkey, count(*) AS n, count(*) FILTER (failed) AS f, max(CASE WHEN NOT failed THEN CAST(round(l_extendedprice * 100) AS BIGINT) END) AS b, sum(CASE WHEN NOT failed THEN l_quantity END) AS q,
      arg_min(l_quantity, (l_linenumber, l_partkey, l_suppkey)) AS first FROM s GROUP BY l_orderkey)
SELECT l_orderkey, n AS n_parts, b AS bitrate_kbps, CASE WHEN n > 1 AND f > 0 THEN first * n ELSE q END AS duration_secs FROM g
""")
def probe_aggregate(spark, sf_dir):
    order = F.struct("l_linenumber", "l_partkey", "l_suppkey")
    return aggregates.aggregate_probes(table(spark, sf_dir, "lineitem"), ["l_orderkey"], order=order, bitrate=cents("l_extendedprice"), duration=F.col("l_quantity"), failed=F.col("l_discount") >= 0.095)


@query("SELECT doc_id, n_chars FROM documents d WHERE EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id)")
def resume_semi(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "n_chars", F.lit(1).alias("size"))
    return joins.resumable(docs, table(spark, sf_dir, "labels").withColumn("marked", F.lit(1)), ["doc_id"], "size", "marked").drop("size")


@query("SELECT doc_id, n_chars FROM documents d WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id)")
def reencode_anti(spark, sf_dir):
    return joins.to_encode(table(spark, sf_dir, "documents").select("doc_id", "n_chars"), table(spark, sf_dir, "labels"), ["doc_id"])


@query("SELECT doc_id, n_chars FROM documents d WHERE EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id AND l.quality = d.n_chars % 2)")
def marker_size_match(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "n_chars", (F.col("n_chars") % 2).alias("size"))
    return joins.resumable(docs, table(spark, sf_dir, "labels"), ["doc_id"], "size", "quality").drop("size")


_PREFIXES = "SELECT DISTINCT regexp_extract(url, '^(https?://[^/?#]+)', 1) AS mount FROM pages UNION SELECT DISTINCT regexp_extract(url, '^(https?://[^/?#]+/[a-z]+)', 1) FROM pages WHERE page_id % 3 = 0"


@query(f"""
WITH m AS (SELECT mount FROM ({_PREFIXES}) WHERE mount <> ''), j AS (
SELECT page_id, url, mount, row_number() OVER (PARTITION BY page_id ORDER BY length(mount) DESC NULLS LAST) AS rn FROM pages LEFT JOIN m ON url = mount OR starts_with(url, mount || '/'))
SELECT page_id, url, mount FROM j WHERE rn = 1
""")
def longest_prefix(spark, sf_dir):
    p = table(spark, sf_dir, "pages").select("page_id", "url")
    host = p.select(F.regexp_extract("url", "^(https?://[^/?#]+)", 1).alias("mount"))
    deep = p.where("page_id % 3 = 0").select(F.regexp_extract("url", "^(https?://[^/?#]+/[a-z]+)", 1).alias("mount"))
    mounts = host.union(deep).distinct().where("mount != ''")
    return joins.longest_prefix(p, mounts, "url", "mount", ["page_id", "url"])


@query("SELECT p_partkey, p_name FROM part WHERE NOT (" + " OR ".join(f"contains(lower(p_name), '{x}')" for x in ("blue", "green", "10", "5")) + ")")
def denylist_theta_anti(spark, sf_dir):
    from functools import reduce

    p = table(spark, sf_dir, "part").select("p_partkey", "p_name")
    return p.where(~reduce(lambda a, b: a | b, [F.lower("p_name").contains(x) for x in ("blue", "green", "10", "5")]))


@query("SELECT count(*) AS n_files, CAST(sum(s) AS BIGINT) AS total_bytes FROM (SELECT o_orderkey, max(CAST(round(o_totalprice * 100) AS BIGINT)) AS s FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY o_orderkey)")
def distinct_bytes(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("l_orderkey"), cents("o_totalprice").alias("size"))
    return aggregates.distinct_bytes(table(spark, sf_dir, "lineitem").select("l_orderkey").join(o, "l_orderkey"), ["l_orderkey"], "size")


@query("""
WITH t AS (SELECT CAST(round(o_totalprice * 100) AS BIGINT) AS a, s AS b FROM orders JOIN (SELECT l_orderkey, CAST(sum(CAST(round(l_extendedprice * 100) AS BIGINT)) AS BIGINT) AS s FROM lineitem GROUP BY 1) ON l_orderkey = o_orderkey)
SELECT count(*) AS n_transcoded, CAST(sum(a) AS BIGINT) AS bytes_in, CAST(sum(b) AS BIGINT) AS bytes_out, CAST(sum(greatest(a - b, 0)) AS BIGINT) AS bytes_saved,
  round(CAST(sum(greatest(a - b, 0)) AS BIGINT) / CAST(sum(a) AS BIGINT) * 100, 6) AS saved_pct, round(CAST(sum(b) AS BIGINT) / CAST(sum(a) AS BIGINT), 6) AS compression_ratio FROM t
""")
def run_summary(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("l_orderkey"), cents("o_totalprice").alias("a"))
    l = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.sum(cents("l_extendedprice")).alias("b"))
    s = aggregates.run_summary(o.join(l, "l_orderkey"), F.col("a"), F.col("b"))
    return s.withColumns({c: F.round(c, 6) for c in ("saved_pct", "compression_ratio")})


@query("""
WITH t AS (SELECT CASE o_orderstatus WHEN 'F' THEN 'transcoded' WHEN 'O' THEN 'skipped' ELSE 'error' END AS o, CAST(round(o_totalprice * 100) AS BIGINT) AS a, o_custkey * 10000 AS b FROM orders),
s AS (SELECT count(*) FILTER (o = 'transcoded') AS n_transcoded, count(*) FILTER (o = 'skipped') AS n_skipped, count(*) FILTER (o = 'error') AS n_errors, CAST(sum(a) FILTER (o = 'transcoded') AS BIGINT) AS bytes_in, CAST(sum(b) FILTER (o = 'transcoded') AS BIGINT) AS bytes_out, CAST(sum(greatest(a - b, 0)) FILTER (o = 'transcoded') AS BIGINT) AS bytes_saved FROM t)
SELECT *, round(bytes_saved / bytes_in * 100, 6) AS saved_pct, round(bytes_out / bytes_in, 6) AS compression_ratio FROM s
""")
def run_counts(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    outcome = F.when(F.col("o_orderstatus") == "F", "transcoded").when(F.col("o_orderstatus") == "O", "skipped").otherwise("error")
    s = aggregates.run_summary(o, cents("o_totalprice"), F.col("o_custkey") * 10000, outcome)
    return s.withColumns({c: F.round(c, 6) for c in ("saved_pct", "compression_ratio")})


@query("SELECT count(*) FILTER (d AND false OR NOT d AND v) AS replaced, count(*) FILTER (d) AS skipped, count(*) FILTER (NOT d AND NOT v) AS failed, CAST(sum(CASE WHEN NOT d AND v THEN greatest(a - b, 0) ELSE 0 END) AS BIGINT) AS bytes_saved FROM (SELECT o_orderstatus = 'P' AS d, o_orderkey % 5 <> 0 AS v, CAST(round(o_totalprice * 100) AS BIGINT) AS a, o_custkey * 10000 AS b FROM orders)")
def replace_summary(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    return aggregates.replace_summary(o, cents("o_totalprice"), F.col("o_custkey") * 10000, F.col("o_orderstatus") == "P", F.col("o_orderkey") % 5 != 0)


@query("""
SELECT o_orderkey, CASE WHEN b >= 1073741824 THEN printf('%.1fGB', round_even(b / 1073741824, 1)) WHEN b >= 1048576 THEN printf('%.0fMB', round_even(b / 1048576, 0)) ELSE printf('%.0fKB', round_even(b / 1024, 0)) END AS size
FROM (SELECT o_orderkey, CAST(round(o_totalprice * 100) AS BIGINT) * 97 AS b FROM orders)
""")
def format_size(spark, sf_dir):
    return table(spark, sf_dir, "orders").select("o_orderkey", scalars.format_size(cents("o_totalprice") * 97).alias("size"))


@query("SELECT o_orderkey, TRY_CAST(nullif(regexp_extract(s, '(?:^|[^0-9])((?:19|20)[0-9]{2})(?:[^0-9]|$)', 1), '') AS INT) AS year FROM (SELECT o_orderkey, 'Order.' || o_orderkey || '.(' || year(o_orderdate) || ').' || o_orderpriority AS s FROM orders)")
def parse_year(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    name = F.concat(F.lit("Order."), F.col("o_orderkey").cast("string"), F.lit(".("), F.year("o_orderdate").cast("string"), F.lit(")."), F.col("o_orderpriority"))
    return o.select("o_orderkey", scalars.parse_year(name).alias("year"))


_WORDS = ["license", "copyright", "rights reserved"]


@query("SELECT doc_id, coalesce(" + " OR ".join(f"contains(lower(text), '{w}')" for w in _WORDS) + ", false) AS flagged FROM documents")
def keyword_flag(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", predicates.looks_like_commentary(F.lit(False), F.col("text"), _WORDS).alias("flagged"))


@query("SELECT event_id, CASE WHEN event_type = 'view' THEN 'session-limit' WHEN event_type = 'click' THEN 'audio-copy' WHEN event_type = 'purchase' THEN 'disk-space' WHEN event_type = 'signup' THEN 'subtitle' ELSE 'unknown' END AS category FROM events")
def error_category(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", errors.category(_message()).alias("category"))


def _message():
    """Event types as encoder messages."""
    t = F.col("event_type")
    return F.when(t == "view", "OpenEncodeSessionEx failed").when(t == "click", "No wav codec tag found for codec pcm_dvd").when(t == "purchase", "No space left on device").when(t == "signup", "Subtitle codec 94213 is not supported").otherwise("some other failure")


_TELLING = ["the", "der", "les", "los"]


@query("""
WITH l AS (SELECT doc_id, list_filter(list_transform(regexp_split_to_array(text, '\\r?\\n'), lambda x: regexp_replace(x, '\\s+$', '')), lambda x: x <> '') AS a FROM documents),
t AS (SELECT doc_id, a, list_filter(a, lambda x: """ + " OR ".join(f"contains(lower(x), '{w}')" for w in _TELLING) + """) AS told FROM l),
d AS (SELECT doc_id, a, list_filter(told, lambda x, i: list_position(told, x) = i) AS first FROM t)
SELECT doc_id, CASE WHEN len(first) > 0 THEN array_to_string(first[1:4], ' | ') WHEN len(a) > 0 THEN array_to_string(a[greatest(len(a) - 2, 1):], ' | ') ELSE 'unknown error' END AS summary FROM d
""")
def summarize_lines(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", errors.summary(F.col("text"), _TELLING).alias("summary"))


@query("SELECT event_id, coalesce(TRY_CAST(json_extract_string(props, '$.k') AS BIGINT), 0) * 1000 // 7 AS scaled FROM events")
def json_extract(spark, sf_dir):
    k = F.from_json("props", "k bigint")["k"]
    x = F.coalesce(k, F.lit(0)) * 1000
    return table(spark, sf_dir, "events").select("event_id", ((x - F.pmod(x, F.lit(7))) / 7).cast("bigint").alias("scaled"))


@query("SELECT conv_id, turn, role, CAST(row_number() OVER (PARTITION BY conv_id, role ORDER BY turn) - 1 AS INT) AS idx FROM conversations")
def nested_posexplode(spark, sf_dir):
    c = table(spark, sf_dir, "conversations")
    turns = c.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role"))).alias("t"))
    by_role = turns.select("conv_id", "t", F.explode(F.array_distinct(F.transform("t", lambda x: x["role"]))).alias("role"))
    mine = by_role.select("conv_id", "role", F.posexplode(F.filter("t", lambda x: x["role"] == F.col("role"))).alias("idx", "x"))
    return mine.select("conv_id", "x.turn", "role", "idx")


@query("SELECT p_partkey, CASE WHEN d = 0 THEN NULL ELSE p_size::BIGINT * 50000 // d END AS scaled FROM (SELECT p_partkey, p_size, p_partkey % 13 AS d FROM part)")
def rational_scale(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    r = F.concat(F.col("p_size").cast("string"), F.lit("/"), (F.col("p_partkey") % 13).cast("string"))
    return p.select("p_partkey", scalars.rational_scaled(r, 50000).alias("scaled"))


@query("SELECT c_custkey, CASE WHEN length(c_name) <= w THEN c_name WHEN w - 2 <= 0 THEN left(c_name, w) ELSE left(c_name, w - 2) || '..' END AS short FROM (SELECT c_custkey, c_name, CAST(c_custkey % 20 AS INT) AS w FROM customer)")
def truncate_name(spark, sf_dir):
    return table(spark, sf_dir, "customer").select("c_custkey", scalars.truncate_name(F.col("c_name"), (F.col("c_custkey") % 20).cast("int")).alias("short"))


@query("SELECT c_custkey, CASE WHEN n >= 10 THEN repeat('=', 10) ELSE repeat('=', n) || '>' || repeat('-', 9 - n) END AS bar FROM (SELECT c_custkey, CAST(greatest(0, least(10, floor(c_acctbal / 10000.0 * 10))) AS INT) AS n FROM customer)")
def progress_bar(spark, sf_dir):
    return table(spark, sf_dir, "customer").select("c_custkey", scalars.progress_bar(F.col("c_acctbal") / 10000.0, 10).alias("bar"))


@query("SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%dT%H:%M:%SZ') AS iso FROM orders")
def iso8601(spark, sf_dir):
    seconds = F.unix_seconds(F.col("o_orderdate").cast("timestamp")) if spark.conf.get("spark.sql.session.timeZone") == "UTC" else F.timestamp_diff("SECOND", F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"), F.col("o_orderdate"))
    return table(spark, sf_dir, "orders").select("o_orderkey", scalars.iso8601(seconds).alias("iso"))


@query("""
WITH RECURSIVE a AS (SELECT user_id, event_type AS t, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS nth FROM events),
r AS (SELECT user_id, CAST(0 AS BIGINT) AS nth, 0 AS disk, 0 AS session, false AS audio, false AS sub, false AS skip, false AS over, '' AS told FROM (SELECT DISTINCT user_id FROM events)
UNION ALL
SELECT user_id, nth, disk + (d = 'disk-space')::INT, session + (d = 'session-limit')::INT, audio OR d = 'reencode-audio', CASE WHEN d = 'skip-subtitles' THEN false ELSE sub OR d = 'reencode-subtitles' END, skip OR d = 'skip-subtitles', d = 'bail', told || ' ' || d
FROM (SELECT r.*  REPLACE (a.nth AS nth), CASE WHEN t = 'purchase' AND disk < 5 THEN 'disk-space' WHEN t = 'click' AND NOT audio THEN 'reencode-audio' WHEN t = 'signup' AND NOT sub AND NOT skip THEN 'reencode-subtitles'
  WHEN t = 'signup' AND NOT skip THEN 'skip-subtitles' WHEN t = 'view' AND session < 5 THEN 'session-limit' ELSE 'bail' END AS d
  FROM r JOIN a ON r.user_id = a.user_id AND a.nth = r.nth + 1 WHERE NOT over))
SELECT user_id, trim(told) AS decisions, disk AS disk_retries, session AS session_retries, audio AS audio_reencoded, skip AS subtitles_skipped, over AS gave_up
FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY nth DESC) AS last FROM r) WHERE last = 1
""")
def retry_fold(spark, sf_dir):
    done = folds.retry_fold(table(spark, sf_dir, "events"), ["user_id"], ["ts", "event_id"], folds.failure_bits(_message()))
    return done.withColumn("decisions", F.array_join("decisions", " "))


@query("""
WITH RECURSIVE h AS (SELECT event_type, date_trunc('hour', ts) AS h, CAST(sum(CAST(round(value * 100) AS BIGINT)) AS BIGINT) AS v FROM events WHERE value IS NOT NULL GROUP BY ALL),
a AS (SELECT event_type, v, row_number() OVER (PARTITION BY event_type ORDER BY h) AS nth FROM h),
r AS (SELECT event_type, CAST(0 AS BIGINT) AS nth, 1 AS cur, CAST(0 AS BIGINT) AS base, true AS ramping, '' AS told FROM (SELECT DISTINCT event_type FROM h)
UNION ALL
SELECT event_type, nth, CASE d WHEN 'ramp-up' THEN cur + 1 WHEN 'stall-revert' THEN greatest(cur - 1, 1) ELSE cur END, CASE WHEN d = 'ramp-up' THEN v ELSE base END, CASE WHEN d LIKE 'stall%' THEN false ELSE ramping END, told || ' ' || d
FROM (SELECT r.* REPLACE (a.nth AS nth), v, CASE WHEN NOT ramping THEN 'off' WHEN v = 0 THEN 'wait' WHEN base = 0 OR v > base THEN 'ramp-up' WHEN v < base * 85 // 100 THEN 'stall-revert' ELSE 'stall' END AS d
  FROM r JOIN a ON r.event_type = a.event_type AND a.nth = r.nth + 1))
SELECT event_type, trim(told) AS actions, cur AS final_max, base AS baseline, ramping FROM (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY nth DESC) AS last FROM r) WHERE last = 1
""")
def ramp_fold(spark, sf_dir):
    e = table(spark, sf_dir, "events").where("value is not null")
    hours = e.groupBy(F.col("event_type"), F.date_trunc("hour", "ts").alias("h")).agg(F.sum(F.round(F.col("value") * 100).cast("bigint")).alias("v"))
    return folds.ramp_fold(hours, ["event_type"], at=F.unix_millis(F.col("h").cast("timestamp")), reporting=F.lit(None).cast("int"), total=F.col("v")).withColumn("actions", F.array_join("actions", " "))


@query("""
SELECT event_id, user_id, hits, cap, hits >= 3 AS frozen FROM (
SELECT event_id, user_id, count(*) OVER w AS hits, greatest(min(CAST(trunc(value) AS BIGINT)) OVER w, 1) AS cap FROM events
WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING))
""")
def running_min_cap(spark, sf_dir):
    out = folds.running_cap(table(spark, sf_dir, "events"), ["user_id"], ["ts", "event_id"], F.col("value").cast("bigint"))
    return out.select("event_id", "user_id", "hits", "cap", "frozen")


@query("""
WITH e AS (SELECT l_suppkey, o_orderdate AS t, 1 AS change, l_orderkey, l_linenumber, l_partkey FROM lineitem JOIN orders ON l_orderkey = o_orderkey
UNION ALL SELECT l_suppkey, l_shipdate, -1, l_orderkey, l_linenumber, l_partkey FROM lineitem)
SELECT l_suppkey, l_orderkey, l_linenumber, l_partkey, change, CAST(sum(change) OVER (PARTITION BY l_suppkey ORDER BY t, change, l_orderkey, l_linenumber, l_partkey ROWS UNBOUNDED PRECEDING) AS BIGINT) AS active FROM e
""")
def admission_replay(spark, sf_dir):
    l = table(spark, sf_dir, "lineitem").select("l_suppkey", "l_orderkey", "l_linenumber", "l_partkey", "l_shipdate")
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_orderdate")
    names = ["l_suppkey", "l_orderkey", "l_linenumber", "l_partkey"]
    e = l.join(o, "l_orderkey").select(*names, F.col("o_orderdate").alias("at"), F.lit(1).alias("change")).union(l.select(*names, "l_shipdate", F.lit(-1)))
    return folds.admission(e, ["l_suppkey"], ["at", "change", "l_orderkey", "l_linenumber", "l_partkey"], F.col("change")).drop("at")


@query("""
SELECT o_orderkey, reserved, reserved = 0 OR greatest(100000000000 - reserved, 0) >= est + 2147483648 AS room FROM (
SELECT o_orderkey, est, CAST(coalesce(sum(est) OVER (PARTITION BY o_orderpriority ORDER BY o_orderdate, o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS reserved FROM (
SELECT o_orderkey, o_orderpriority, o_orderdate, greatest(CAST(round(o_totalprice * 100) AS BIGINT) * 1000 // 2, 104857600) AS est FROM orders))
""")
def disk_gate(spark, sf_dir):
    o = table(spark, sf_dir, "orders").withColumn("est", scalars.disk_estimate(cents("o_totalprice") * 1000))
    out = folds.disk_gate(o, ["o_orderpriority"], ["o_orderdate", "o_orderkey"], F.lit(100000000000), F.col("est"))
    return out.select("o_orderkey", "reserved", "room")


@query("""
WITH c AS (SELECT user_id, ts, max(CASE WHEN event_type = 'signup' THEN coalesce(CAST(event_id % 5 = 0 AS VARCHAR), '') END) AS paused, max(CASE WHEN event_type = 'error' THEN CAST(event_id % 9 - 2 AS VARCHAR) END) AS jobs FROM events WHERE event_type IN ('signup', 'error') GROUP BY ALL),
t AS (SELECT event_id, user_id, ts FROM events WHERE event_type NOT IN ('signup', 'error'))
SELECT t.event_id, t.user_id, true AS enabled, coalesce(CAST(p.paused AS BOOLEAN), false) AS paused, CAST(greatest(coalesce(CAST(j.jobs AS INTEGER), 0), 0) AS INTEGER) AS max_jobs
FROM t ASOF LEFT JOIN (SELECT * FROM c WHERE paused IS NOT NULL) p ON t.user_id = p.user_id AND t.ts >= p.ts ASOF LEFT JOIN (SELECT * FROM c WHERE jobs IS NOT NULL) j ON t.user_id = j.user_id AND t.ts >= j.ts
""")
def flags_as_of(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    told = e.where("event_type in ('signup', 'error')")
    pause = F.col("event_type") == "signup"
    changes = told.select("user_id", "ts", F.when(pause, "paused").otherwise("max_jobs").alias("flag"), F.when(pause, (F.col("event_id") % 5 == 0).cast("string")).otherwise((F.col("event_id") % 9 - 2).cast("string")).alias("value"))
    ticks = e.where("event_type not in ('signup', 'error')").select("event_id", "user_id", "ts")
    return folds.flags_as_of(ticks, changes, ["user_id"], "ts", ["event_id"]).drop("ts")


@query("""
WITH r AS (SELECT l_suppkey, l_orderkey, l_linenumber, l_partkey, l_shipdate AS t, 0 AS side, greatest(CAST(round(l_extendedprice * 100) AS BIGINT) // 2, 104857600) AS est FROM lineitem),
e AS (SELECT *, est AS taken, 0 AS back FROM r UNION ALL SELECT l_suppkey, l_orderkey, l_linenumber, l_partkey, t + INTERVAL 20 DAY, 1, est, 0, est FROM r),
s AS (SELECT *, greatest(CAST(coalesce(sum(taken - back) OVER (PARTITION BY l_suppkey ORDER BY t, side, l_orderkey, l_linenumber, l_partkey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT), 0) AS reserved FROM e)
SELECT l_suppkey, l_orderkey, l_linenumber, l_partkey, reserved, reserved = 0 OR greatest(2600000000 - reserved, 0) >= est + 2147483648 AS room FROM s WHERE side = 0
""")
def disk_release(spark, sf_dir):
    est = scalars.disk_estimate(cents("l_extendedprice"))
    names = ["l_suppkey", "l_orderkey", "l_linenumber", "l_partkey"]
    r = table(spark, sf_dir, "lineitem").select(*names, F.col("l_shipdate").alias("at"), F.lit(0).alias("side"), est.alias("est"))
    back = r.select(*names, (F.col("at") + F.expr("interval 20 days")).alias("at"), F.lit(1).alias("side"), "est")
    taken, given = F.when(F.col("side") == 0, F.col("est")), F.when(F.col("side") == 1, F.col("est"))
    out = folds.disk_gate(r.union(back), ["l_suppkey"], ["at", "side", "l_orderkey", "l_linenumber", "l_partkey"], F.lit(2600000000), F.coalesce(taken, F.lit(0)), release=given)
    return out.where("side = 0").select(*names, "reserved", "room")


@query("""
WITH e AS (SELECT event_id, user_id, ts, greatest(CASE WHEN event_id % 4 < 2 THEN event_id % 11 - 2 ELSE 0 END, 0) AS flag, (event_type = 'error')::INTEGER AS hit FROM events),
w AS (SELECT *, lag(flag, 1, 0) OVER o AS was, sum(hit) OVER o >= 3 AS frozen FROM e WINDOW o AS (PARTITION BY user_id ORDER BY ts, event_id))
SELECT event_id, CASE WHEN flag > 0 THEN least(flag, 6) END AS forced, flag = 0 AND was > 0 AND NOT frozen AS rearmed, frozen FROM w
""")
def flag_override(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("event_id", "user_id", "ts", "event_type")
    flag = F.when(F.col("event_id") % 4 < 2, F.col("event_id") % 11 - 2)
    out = folds.flag_override(e, ["user_id"], ["ts", "event_id"], flag, F.col("event_type") == "error", slots=6)
    return out.select("event_id", "forced", "rearmed", "frozen")


@query("SELECT c_custkey FROM customer EXCEPT SELECT o_custkey FROM orders WHERE o_totalprice > 250000")
def set_diff(spark, sf_dir):
    large = table(spark, sf_dir, "orders").where("o_totalprice > 250000")
    return joins.missing(table(spark, sf_dir, "customer"), large.withColumnRenamed("o_custkey", "c_custkey"), ["c_custkey"])


@query("SELECT o_orderkey, CAST(CASE WHEN a = 0 THEN 0 ELSE trunc((a - b) / a * 100) END AS INT) AS saved_pct FROM (SELECT o_orderkey, CAST(round(o_totalprice * 100) AS BIGINT) AS a, o_custkey * 10000 AS b FROM orders)")
def saved_percent(spark, sf_dir):
    return table(spark, sf_dir, "orders").select("o_orderkey", scalars.saved_percent(cents("o_totalprice"), F.col("o_custkey") * 10000).alias("saved_pct"))


@query("SELECT event_type, time_bucket(INTERVAL 1 HOUR, ts) AS window_start, count(*) AS n, CAST(sum(CAST(round(value * 100) AS BIGINT)) AS BIGINT) AS total FROM events GROUP BY ALL")
def stream_event_windows(spark, sf_dir):
    return streams.event_windows(spark, f"{sf_dir}/events.parquet")


@query("""
WITH e AS (SELECT user_id, ts, lag(ts) OVER (PARTITION BY user_id ORDER BY ts) AS before FROM events),
s AS (SELECT user_id, ts, sum(CASE WHEN before IS NULL OR ts - before > INTERVAL 30 MINUTE THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM e)
SELECT user_id, min(ts) AS session_start, max(ts) + INTERVAL 30 MINUTE AS session_end, count(*) AS n FROM s GROUP BY user_id, k
""")
def stream_sessions(spark, sf_dir):
    return streams.sessions(spark, f"{sf_dir}/events.parquet")


@query("SELECT event_type, s AS window_start, count(*) AS n FROM (SELECT event_type, unnest([time_bucket(INTERVAL 30 MINUTE, ts), time_bucket(INTERVAL 30 MINUTE, ts) - INTERVAL 30 MINUTE]) AS s FROM events) GROUP BY ALL")
def stream_late_windows(spark, sf_dir):
    return streams.late_counts(spark, f"{sf_dir}/events.parquet")


@query("SELECT b.user_id, b.event_id AS purchase_id, v.event_id AS view_id FROM events b JOIN events v ON b.user_id = v.user_id AND b.event_type = 'purchase' AND v.event_type = 'view' AND v.ts <= b.ts AND v.ts >= b.ts - INTERVAL 1 HOUR")
def stream_join(spark, sf_dir):
    return streams.purchases_after_views(spark, f"{sf_dir}/events.parquet")


@query("SELECT event_id, CAST(floor(CAST((event_id % 10) || '.' || lpad(CAST(event_id % 100 AS VARCHAR), 2, '0') AS DOUBLE) * 100) AS BIGINT) AS speed FROM events")
def stream_progress(spark, sf_dir):
    return streams.progress(spark, f"{sf_dir}/events.parquet")


@query("SELECT DISTINCT user_id, event_type FROM events")
def stream_dedup(spark, sf_dir):
    return streams.distinct_pairs(spark, f"{sf_dir}/events.parquet")


@query("""
WITH e AS (SELECT event_type, ts, event_id, CAST(event_id * 8 // (max(event_id) OVER () + 1) AS INTEGER) + CASE WHEN event_id % 13 = 0 THEN 3 ELSE 0 END AS s FROM events),
m AS (SELECT s, max(max(ts)) OVER (ORDER BY s) - INTERVAL 12 HOUR AS closed FROM e GROUP BY s),
k AS (SELECT event_type, time_bucket(INTERVAL 1 HOUR, ts) AS window_start FROM e LEFT JOIN m ON m.s = e.s - 2 WHERE closed IS NULL OR time_bucket(INTERVAL 1 HOUR, ts) + INTERVAL 1 HOUR > closed)
SELECT event_type, window_start, count(*) AS n FROM k WHERE window_start + INTERVAL 1 HOUR <= (SELECT max(closed) FROM m) GROUP BY ALL
""")
def stream_closed_windows(spark, sf_dir):
    return streams.closed_windows(spark, f"{sf_dir}/events.parquet")


@query("""
WITH RECURSIVE a AS (SELECT user_id, event_id, event_type AS t, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS nth FROM events),
r AS (SELECT user_id, CAST(NULL AS BIGINT) AS event_id, CAST(0 AS BIGINT) AS nth, 0 AS disk, 0 AS session, false AS audio, false AS sub, false AS skip, false AS over, '' AS d FROM (SELECT DISTINCT user_id FROM events)
UNION ALL
SELECT user_id, event_id, nth, disk + (d = 'disk-space')::INT, session + (d = 'session-limit')::INT, audio OR d = 'reencode-audio', CASE WHEN d = 'skip-subtitles' THEN false ELSE sub OR d = 'reencode-subtitles' END, skip OR d = 'skip-subtitles', d = 'bail', d
FROM (SELECT r.*  REPLACE (a.nth AS nth, a.event_id AS event_id, CASE WHEN t = 'purchase' AND disk < 5 THEN 'disk-space' WHEN t = 'click' AND NOT audio THEN 'reencode-audio' WHEN t = 'signup' AND NOT sub AND NOT skip THEN 'reencode-subtitles'
  WHEN t = 'signup' AND NOT skip THEN 'skip-subtitles' WHEN t = 'view' AND session < 5 THEN 'session-limit' ELSE 'bail' END AS d)
  FROM r JOIN a ON r.user_id = a.user_id AND a.nth = r.nth + 1 WHERE NOT over))
SELECT user_id, event_id, d AS decision FROM r WHERE nth > 0
""")
def stream_retries(spark, sf_dir):
    path = f"{sf_dir}/events.parquet"
    attempts = streams.events(spark, path).select("user_id", "event_id", "ts", folds.failure_bits(_message()).alias("bits"))
    return streams.finished(streams.retries(attempts, "user_id", "event_id"), "retries", path, provider=streams.ROCKS)


@query("SELECT DISTINCT doc_id, n_chars FROM documents d WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id AND l.quality = d.n_chars % 2)")
def stream_resume(spark, sf_dir):
    path = f"{sf_dir}/documents.parquet"
    listing = streams.files(spark, path).select("doc_id", "n_chars", (F.col("n_chars") % 2).alias("size"))
    new = streams.unmarked(listing, table(spark, sf_dir, "labels"), ["doc_id"], "size", "quality")
    return streams.finished(new.select("doc_id", "n_chars"), "resume", path, f"{sf_dir}/labels.parquet")


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The dry run: classify everything, then how much of it there is to do."""
    c = outcome_counts(spark, sf_dir)
    return c.withColumn("size", scalars.format_size(F.col("bytes"))).orderBy("outcome")
