"""Registered queries over the star schema: each operator of the library applied to whole tables, with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.functions import text as T
from lodestone.operators import backup_tree, export, ordered, redact, tree
from lodestone.sources import backup
from lodestone.sources.store import dealt, stored

QUERIES: dict = {}
ORACLES: dict = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = lambda spark, sf_dir: f(lambda name: spark.read.parquet(f"{sf_dir}/{name}.parquet"))
        QUERIES[f.__name__].__doc__ = f.__doc__
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def _levels(t) -> list[tree.Level]:
    return [
        tree.Level("region", t("region"), "r_regionkey", None, F.col("r_name"), False),
        tree.Level("nation", t("nation"), "n_nationkey", "n_regionkey", F.col("n_name"), False),
        tree.Level("customer", t("customer"), "c_custkey", "c_nationkey", F.col("c_name")),
    ]


def _key_sql(c: str) -> str:
    return f"lpad(CAST(length(CAST({c} AS VARCHAR)) AS VARCHAR), 3, '0') || '.' || {c}"


NODES = f"""
SELECT 'region:' || r_regionkey AS node_id, CAST(NULL AS VARCHAR) AS parent_id, 'region' AS kind, r_name AS title, 0 AS depth,
       '/region:' || {_key_sql("r_regionkey")} AS path_key, false AS has_raw FROM region
UNION ALL SELECT 'nation:' || n_nationkey, 'region:' || r_regionkey, 'nation', n_name, 1,
       '/region:' || {_key_sql("r_regionkey")} || '/nation:' || {_key_sql("n_nationkey")}, false
  FROM nation JOIN region ON n_regionkey = r_regionkey
UNION ALL SELECT 'customer:' || c_custkey, 'nation:' || n_nationkey, 'customer', c_name, 2,
       '/region:' || {_key_sql("r_regionkey")} || '/nation:' || {_key_sql("n_nationkey")} || '/customer:' || {_key_sql("c_custkey")}, true
  FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
"""


@query(NODES)
def tree_flatten(t):
    return tree.nodes(_levels(t))


@query(f"SELECT node_id, title FROM ({NODES}) WHERE parent_id = 'nation:3'")
def tree_children(t):
    return tree.nodes(_levels(t)).filter("parent_id = 'nation:3'").select("node_id", "title")


@query(f"SELECT kind, count(*) AS n, CAST(sum(CASE WHEN has_raw THEN 1 ELSE 0 END) AS BIGINT) AS with_raw FROM ({NODES}) GROUP BY kind")
def category_badges(t):
    return tree.nodes(_levels(t)).groupBy("kind").agg(F.count("*").alias("n"), F.count_if("has_raw").alias("with_raw"))


@query(f"SELECT node_id, kind, title, path_key FROM ({NODES}) WHERE node_id = 'nation:7'")
def node_lookup(t):
    return tree.nodes(_levels(t)).filter("node_id = 'nation:7'").select("node_id", "kind", "title", "path_key")


@query(f"SELECT node_id FROM ({NODES}) WHERE path_key LIKE '/region:001.1/%' OR node_id = 'region:1' OR node_id = 'region:2'")
def toggle_descendants(t):
    nodes = tree.nodes(_levels(t))
    return tree.toggled(nodes.filter("node_id = 'region:2'").select("node_id"), nodes, "region:1", True)


@query(f"SELECT node_id FROM ({NODES}) WHERE kind = 'nation' AND path_key NOT LIKE '/region:001.1/%'")
def toggle_off(t):
    nodes = tree.nodes(_levels(t))
    return tree.toggled(nodes.filter("kind = 'nation'").select("node_id"), nodes, "region:1", False)


@query("SELECT n_nationkey, n_name, r_name FROM nation JOIN region ON n_regionkey = r_regionkey")
def site_children(t):
    return t("nation").join(t("region"), F.col("n_regionkey") == F.col("r_regionkey")).select("n_nationkey", "n_name", "r_name")


@query("SELECT n_nationkey, n_name, count(s_suppkey) AS members FROM nation LEFT JOIN supplier ON s_nationkey = n_nationkey AND s_acctbal > 8000 GROUP BY 1, 2")
def group_members_left(t):
    rich = t("supplier").filter("s_acctbal > 8000")
    return t("nation").join(rich, F.col("s_nationkey") == F.col("n_nationkey"), "left").groupBy("n_nationkey", "n_name").agg(F.count("s_suppkey").alias("members"))


@query("SELECT doc_id, lang FROM documents d WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id)")
def ungrouped_anti(t):
    return t("documents").join(t("labels"), "doc_id", "left_anti").select("doc_id", "lang")


@query("SELECT c_custkey, c_name FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 400000)")
def selection_semi(t):
    large = t("orders").filter("o_totalprice > 400000")
    return t("customer").join(large, F.col("o_custkey") == F.col("c_custkey"), "left_semi").select("c_custkey", "c_name")


FILLED = """SELECT event_id, user_id, coalesce(last_value(CASE WHEN event_type = 'error' THEN 'error@' || event_id END IGNORE NULLS)
  OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), '_uncategorized') AS collection, ts, event_type FROM events"""


def _filled(t) -> DataFrame:
    marker = F.when(F.col("event_type") == "error", F.concat(F.lit("error@"), F.col("event_id").cast("string")))
    return ordered.forward_fill(t("events"), ["user_id"], ["ts", "event_id"], marker)


@query(f"SELECT event_id, user_id, collection FROM ({FILLED}) WHERE event_type <> 'error'")
def marker_forward_fill(t):
    return _filled(t).filter("event_type <> 'error'").select("event_id", "user_id", "collection")


@query(f"SELECT user_id, event_id FROM (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM ({FILLED}) WHERE collection = '_uncategorized') WHERE k <= 2")
def orphan_samples(t):
    return ordered.pick_first(_filled(t).filter("collection = '_uncategorized'"), ["user_id"], [F.col("ts"), F.col("event_id")], 2).select("user_id", "event_id")


@query("SELECT event_id, e.user_id FROM events e LEFT JOIN (SELECT user_id, min(event_id) AS f FROM events WHERE event_type = 'error' GROUP BY 1) x ON x.user_id = e.user_id WHERE f IS NULL OR event_id < f")
def stream_cutoff(t):
    return ordered.cut_off(t("events"), ["user_id"], "event_id", F.col("event_type") == "error").select("event_id", "user_id")


@query("SELECT event_type, count(*) AS n, min(event_id) AS first_seen FROM events GROUP BY 1")
def collection_counts(t):
    return t("events").groupBy("event_type").agg(F.count("*").alias("n"), F.min("event_id").alias("first_seen"))


@query("""SELECT string_agg(event_type || '(' || n || ')', ', ' ORDER BY f) AS summary FROM
  (SELECT event_type, count(*) AS n, min(event_id) AS f FROM events WHERE event_type NOT IN ('view', 'click') GROUP BY 1)""")
def opaque_summary(t):
    counts = t("events").filter(~F.col("event_type").isin("view", "click")).groupBy("event_type").agg(F.count("*").alias("n"), F.min("event_id").alias("f"))
    listed = F.sort_array(F.collect_list(F.struct("f", F.concat("event_type", F.lit("("), F.col("n").cast("string"), F.lit(")")).alias("s"))))
    return counts.agg(F.array_join(F.transform(listed, lambda x: x["s"]), ", ").alias("summary"))


@query("""SELECT user_id, day, CASE WHEN s AND NOT e AND NOT v THEN 'siteExport' WHEN s AND NOT p THEN 'settingsOnly' WHEN s THEN 'full' ELSE 'unknown' END AS kind FROM (
  SELECT user_id, strftime(ts, '%Y-%m-%d') AS day, bool_or(event_type = 'signup') AS s, bool_or(event_type = 'error') AS e, bool_or(event_type = 'view') AS v, bool_or(event_type = 'purchase') AS p FROM events GROUP BY 1, 2)""")
def kind_detection(t):
    has = {k: F.bool_or(F.col("event_type") == v) for k, v in {"s": "signup", "e": "error", "v": "view", "p": "purchase"}.items()}
    flags = t("events").groupBy("user_id", F.date_format("ts", "yyyy-MM-dd").alias("day")).agg(*[v.alias(k) for k, v in has.items()])
    kind = F.when(F.expr("s AND NOT e AND NOT v"), "siteExport").when(F.expr("s AND NOT p"), "settingsOnly").when(F.col("s"), "full").otherwise("unknown")
    return flags.select("user_id", "day", kind.alias("kind"))


@query("""SELECT page_id, CASE WHEN contains(lower(url), 'm.') THEN 'mobile' WHEN contains(lower(url), 'blog') THEN 'blog' WHEN contains(lower(url), 'www') THEN 'web' ELSE 'unknown' END AS origin FROM pages""")
def origin_rules(t):
    return t("pages").select("page_id", T.first_rule(F.col("url"), [("m.", "mobile"), ("blog", "blog"), ("www", "web")], "unknown").alias("origin"))


@query("SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, json_extract_string(props, '$.missing') AS missing FROM events")
def typed_projection(t):
    return t("events").select("event_id", F.get_json_object("props", "$.k").cast("long").alias("k"), F.get_json_object("props", "$.missing").alias("missing"))


@query("SELECT event_id, epoch_us(ts) // 1000 AS millis, strftime(ts, '%Y-%m-%dT%H:%M:%SZ') AS iso FROM events")
def epoch_coercion(t):
    ts = F.col("ts").cast("timestamp")
    return t("events").select("event_id", F.unix_millis(T.epoch_or_iso(F.unix_millis(ts).cast("string"))).alias("millis"), F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("iso"))


@query("SELECT p_partkey, concat_ws(' ', p_name, CASE WHEN p_size > 25 THEN p_brand END) AS title FROM part")
def title_concat_ws(t):
    return t("part").select("p_partkey", T.title(F.col("p_name"), F.when(F.col("p_size") > 25, F.col("p_brand"))).alias("title"))


@query("SELECT vec_id, CASE WHEN len(embedding) > 8 THEN '[' || len(embedding) || ' items]' ELSE '[]' END AS display FROM embeddings")
def display_render(t):
    return t("embeddings").select("vec_id", T.array_text(F.col("embedding")).alias("display"))


@query("SELECT doc_id, contains(lower(text), 'license') OR contains(lower(source), 'license') AS hit FROM documents")
def search_filter(t):
    return t("documents").select("doc_id", T.matches("License", F.col("text"), F.col("source")).alias("hit"))


@query("""SELECT severity, count(*) AS n, max(rank) AS worst FROM (SELECT CASE event_type WHEN 'error' THEN 'error' WHEN 'purchase' THEN 'warning' ELSE 'info' END AS severity,
  CASE event_type WHEN 'error' THEN 2 WHEN 'purchase' THEN 1 ELSE 0 END AS rank FROM events) WHERE severity <> 'info' GROUP BY 1""")
def severity_badge(t):
    severity = F.when(F.col("event_type") == "error", "error").when(F.col("event_type") == "purchase", "warning").otherwise("info")
    rows = t("events").select(severity.alias("severity")).withColumn("rank", F.when(F.col("severity") == "error", 2).when(F.col("severity") == "warning", 1).otherwise(0))
    return rows.filter("severity <> 'info'").groupBy("severity").agg(F.count("*").alias("n"), F.max("rank").alias("worst"))


def _count_sql(kind: str, p: str) -> str:
    return f"SELECT '{kind}' AS kind, CAST(sum(len(regexp_extract_all(text, '{p}'))) AS BIGINT) AS occurrences, CAST(sum(CASE WHEN regexp_matches(text, '{p}') THEN 1 ELSE 0 END) AS BIGINT) AS documents FROM documents"


@query(" UNION ALL ".join(_count_sql(k, p) for k, p in redact.PATTERNS.items()))
def secret_inventory(t):
    return redact.inventory(t("documents"), "text")


_REDACTED_SQL = "text"
for _p in redact.PATTERNS.values():
    _REDACTED_SQL = f"regexp_replace({_REDACTED_SQL}, '{_p}', '<redacted>', 'g')"


@query(f"SELECT conv_id, turn, md5({_REDACTED_SQL}) AS redacted FROM conversations")
def redact_conversations(t):
    return t("conversations").select("conv_id", "turn", F.md5(redact.redact_text(F.col("text"))).alias("redacted"))


@query(f"SELECT doc_id, md5({_REDACTED_SQL}) AS redacted FROM documents")
def redact_text(t):
    return t("documents").select("doc_id", F.md5(redact.redact_text(F.col("text"))).alias("redacted"))


@query("SELECT c_custkey, '<redacted>' AS c_name, '<redacted>' AS c_acctbal, c_mktsegment FROM customer")
def redact_fields(t):
    return redact.redact_fields(t("customer"), ["c_name", "c_acctbal"]).select("c_custkey", "c_name", "c_acctbal", "c_mktsegment")


@query("SELECT event_type, count(*) AS n FROM (SELECT event_type FROM events UNION ALL SELECT event_type FROM events WHERE value > 50) GROUP BY 1")
def stats_merge(t):
    return t("events").select("event_type").unionByName(t("events").filter("value > 50").select("event_type")).groupBy("event_type").agg(F.count("*").alias("n"))


@query("SELECT p_partkey, p_type FROM part WHERE NOT (starts_with(p_type, 'ECONOMY') OR starts_with(p_type, 'PROMO'))")
def stat_prefix_prune(t):
    return t("part").filter(~F.col("p_type").rlike("^(ECONOMY|PROMO)")).select("p_partkey", "p_type")


@query("""SELECT p_brand, p_partkey FROM (SELECT p_brand, p_partkey, row_number() OVER (PARTITION BY p_brand ORDER BY CASE WHEN p_name LIKE '%ring' THEN 0 WHEN p_size > 25 THEN 1 ELSE 2 END, p_retailprice DESC, p_partkey) AS k FROM part) WHERE k = 1""")
def embedded_pick(t):
    tier = F.when(F.col("p_name").endswith("ring"), 0).when(F.col("p_size") > 25, 1).otherwise(2)
    return ordered.pick_first(t("part"), ["p_brand"], [tier, F.desc("p_retailprice"), F.col("p_partkey")]).select("p_brand", "p_partkey")


@query("SELECT user_id, event_type, arg_max(value, event_id) AS value FROM events GROUP BY 1, 2")
def last_wins_lookup(t):
    return ordered.last_wins(t("events"), ["user_id", "event_type"], "value", "event_id")


_SECTIONS = "(SELECT c_custkey AS ord, 'customer' AS tag, c_name AS title, unnest([{'key': 'c_nationkey', 'value': CAST(c_nationkey AS VARCHAR), 'pos': 0}, {'key': 'c_mktsegment', 'value': c_mktsegment, 'pos': 1}]) AS f FROM customer)"


def _sections(t) -> DataFrame:
    return export.sections(t("customer"), "customer", F.col("c_name"), F.col("c_custkey"), ["c_nationkey", "c_mktsegment"])


@query(f"SELECT ord, tag, title, f.pos AS pos, f.key AS key, f.value AS value FROM {_SECTIONS}")
def export_sections(t):
    return export.field_rows(_sections(t))


@query("SELECT c_custkey AS ord, 'CUSTOMER: ' || c_name || chr(10) || '  c_nationkey: ' || c_nationkey || chr(10) || '  c_mktsegment: ' || c_mktsegment AS body FROM customer")
def text_render(t):
    return export.export(_sections(t), "text")


@query("""SELECT c_custkey AS ord, '<customer title="' || c_name || '">' || chr(10) || '| Key | Value |' || chr(10) || '| --- | --- |' || chr(10) || '| c_nationkey | ' || c_nationkey || ' |' || chr(10) || '| c_mktsegment | ' || c_mktsegment || ' |' || chr(10) || '</customer>' AS body FROM customer""")
def markdown_tags(t):
    return export.export(_sections(t), "markdown", "claude")


@query("""SELECT c_custkey AS ord, '## Customer: ' || c_name || chr(10) || '| Key | Value |' || chr(10) || '| --- | --- |' || chr(10) || '| c_nationkey | ' || c_nationkey || ' |' || chr(10) || '| c_mktsegment | ' || c_mktsegment || ' |' AS body FROM customer""")
def markdown_headings(t):
    return export.export(_sections(t), "markdown", "gpt")


@query("""SELECT c_custkey AS ord, '{' || chr(10) || '  "fields" : [ {' || chr(10) || '    "key" : "c_nationkey",' || chr(10) || '    "value" : "' || c_nationkey || '"' || chr(10) || '  }, {' || chr(10)
  || '    "key" : "c_mktsegment",' || chr(10) || '    "value" : "' || c_mktsegment || '"' || chr(10) || '  } ],' || chr(10) || '  "kind" : "customer",' || chr(10) || '  "title" : "' || c_name || '"' || chr(10) || '}' AS body FROM customer""")
def json_sections(t):
    return export.export(_sections(t), "json")


@query("""SELECT preset, budget, (SELECT CAST(sum(n_chars) AS BIGINT) FROM documents) AS total, (SELECT sum(n_chars) FROM documents) > budget AS over
  FROM (VALUES ('claude', CAST(240000 AS BIGINT)), ('gpt', 320000), ('gemini', 800000), ('local', 24000)) v(preset, budget)""")
def budget_check(t):
    docs = t("documents")
    return export.over_budget(docs.sparkSession, docs.select(F.col("n_chars").alias("n")))


@query("SELECT doc_id, replace(replace(text, '|', chr(92) || '|'), chr(10), ' ') AS cell FROM documents")
def markdown_rows(t):
    return t("documents").select("doc_id", T.table_cell(F.col("text")).alias("cell"))


@query("SELECT string_agg('- [' || event_type || '] ' || n, chr(10) ORDER BY event_type) AS report FROM (SELECT event_type, count(*) AS n FROM events GROUP BY 1)")
def diag_report(t):
    counts = t("events").groupBy("event_type").agg(F.count("*").alias("n"))
    lines = F.sort_array(F.collect_list(F.concat(F.lit("- ["), F.col("event_type"), F.lit("] "), F.col("n").cast("string"))))
    return counts.agg(F.array_join(lines, "\n").alias("report"))


@query("SELECT doc_id, substr(text, 1, 2000) AS preview FROM documents")
def preview_2000(t):
    return t("documents").select("doc_id", F.substring("text", 1, 2000).alias("preview"))


@query(r"SELECT doc_id, regexp_replace(text, '^[\s\p{C}]+|[\s\p{C}]+$', '', 'g') AS clean FROM (SELECT doc_id, chr(65279) || '  ' || text || chr(13) || chr(10) AS text FROM documents)")
def sanitise_text(t):
    return t("documents").select("doc_id", T.sanitise(F.concat(F.lit("﻿  "), F.col("text"), F.lit("\r\n"))).alias("clean"))


@query(r"SELECT page_id, regexp_replace(regexp_replace(url, '^.*/', ''), '\.[^.]+$', '') AS name FROM pages")
def path_basename(t):
    return t("pages").select("page_id", T.basename(F.col("url")).alias("name"))


@query("SELECT lang, count(*) AS n, CAST(sum(n_chars) AS BIGINT) AS chars, lang || ': ' || count(*) || ' documents, ' || CAST(sum(n_chars) AS BIGINT) || ' characters' AS hint FROM documents GROUP BY lang")
def budget_hint_text(t):
    sums = t("documents").groupBy("lang").agg(F.count("*").alias("n"), F.sum("n_chars").alias("chars"))
    return sums.withColumn("hint", F.concat("lang", F.lit(": "), F.col("n").cast("string"), F.lit(" documents, "), F.col("chars").cast("string"), F.lit(" characters")))


@query("SELECT o_orderkey, lpad(lower(to_hex(o_orderkey)), 24, '0') AS oid, '{\"$date\":\"' || strftime(o_orderdate, '%Y-%m-%dT%H:%M:%SZ') || '\"}' AS date FROM orders")
def extended_json_value(t):
    date = F.concat(F.lit('{"$date":"'), F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss'Z'"), F.lit('"}'))
    return t("orders").select("o_orderkey", T.hex_id(F.col("o_orderkey")).alias("oid"), date.alias("date"))


@query("SELECT event_id, array_to_string(json_keys(props), ',') AS keys, len(json_keys(props)) AS n, coalesce(json_extract_string(props, '$.id'), '') AS id FROM events")
def field_accessors(t):
    keys = F.json_object_keys("props")
    return t("events").select("event_id", F.array_join(keys, ",").alias("keys"), F.size(keys).cast("long").alias("n"), F.coalesce(F.get_json_object("props", "$.id"), F.lit("")).alias("id"))


@query("SELECT conv_id, max(CASE WHEN role = 'user' THEN length(text) END) AS user_chars, max(CASE WHEN role = 'assistant' THEN length(text) END) AS assistant_chars, max(CASE WHEN turn = 0 THEN trim(role) END) AS opened_by FROM conversations GROUP BY 1")
def identity_row(t):
    size = F.length("text").cast("long")
    return t("conversations").groupBy("conv_id").agg(F.max(F.when(F.col("role") == "user", size)).alias("user_chars"), F.max(F.when(F.col("role") == "assistant", size)).alias("assistant_chars"), F.max(F.when(F.col("turn") == 0, F.trim("role"))).alias("opened_by"))


@query("""SELECT n_name, count(*) AS lines, round(sum(l_quantity), 2) AS quantity FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey
  JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey GROUP BY 1""")
def fk_resolution(t):
    lines = t("lineitem").join(t("orders"), F.col("l_orderkey") == F.col("o_orderkey")).join(t("customer").select("c_custkey"), F.col("o_custkey") == F.col("c_custkey"))
    placed = lines.join(t("supplier").select("s_suppkey", "s_nationkey"), F.col("l_suppkey") == F.col("s_suppkey")).join(t("nation").select("n_nationkey", "n_name"), F.col("s_nationkey") == F.col("n_nationkey"))
    return placed.groupBy("n_name").agg(F.count("*").alias("lines"), F.round(F.sum("l_quantity"), 2).alias("quantity"))


@query("SELECT CASE WHEN length(html) = 0 THEN 'empty' WHEN contains(html, '<html') THEN 'ok' ELSE 'notHtml' END AS status, count(*) AS n FROM pages GROUP BY 1")
def file_status(t):
    status = F.when(F.length("html") == 0, "empty").when(F.contains(F.col("html"), F.lit("<html")), "ok").otherwise("notHtml")
    return t("pages").groupBy(status.alias("status")).agg(F.count("*").alias("n"))


@query("SELECT o_orderkey, 'export-' || o_orderkey || '-' || strftime(o_orderdate, '%Y-%m-%d') || CASE WHEN o_orderstatus = 'F' THEN '-secrets' ELSE '' END || '.md' AS name FROM orders")
def filename_rule(t):
    name = F.concat(F.lit("export-"), F.col("o_orderkey").cast("string"), F.lit("-"), F.date_format("o_orderdate", "yyyy-MM-dd"), F.when(F.col("o_orderstatus") == "F", "-secrets").otherwise(""), F.lit(".md"))
    return t("orders").select("o_orderkey", name.alias("name"))


@query("SELECT 'nation' AS kind, CAST(n_nationkey AS VARCHAR) AS id, n_name AS title, false AS has_raw FROM nation UNION ALL SELECT 'opaque', CAST(p_partkey AS VARCHAR), p_name, true FROM part")
def node_table(t):
    nations = t("nation").select(F.lit("nation").alias("kind"), F.col("n_nationkey").cast("string").alias("id"), F.col("n_name").alias("title"), F.lit(False).alias("has_raw"))
    return nations.unionByName(t("part").select(F.lit("opaque").alias("kind"), F.col("p_partkey").cast("string").alias("id"), F.col("p_name").alias("title"), F.lit(True).alias("has_raw")))


#: Customers of one archive, at most.
PART = 10_000
_PATH = f"'nation-' || c_nationkey || '-' || (c_custkey // {PART})"
_SITE = "lpad(lower(to_hex(c_nationkey + 1)), 24, '0')"
_WLANS = "FROM customer WHERE c_custkey % 10 = 0"
_ARCHIVES = f"(SELECT DISTINCT {_PATH} AS path, c_nationkey, {_SITE} AS site FROM customer)"


def _backups(t) -> DataFrame:
    """Archives of PART customers of a nation at most: streams of documents behind markers."""
    import gzip
    import io
    import zipfile

    import pandas as pd

    from lodestone.sources import bson

    def some(**fields) -> dict:
        return {("_id" if k == "id" else k): v for k, v in fields.items() if v is not None}

    def pack(part: pd.DataFrame) -> pd.DataFrame:
        nation, first = int(part["c_nationkey"].iloc[0]), int(part["c_custkey"].iloc[0])
        site = bson.Typed("objectId", f"{nation + 1:024x}")
        rows = [(int(k), n) for k, n in zip(part["c_custkey"], part["c_name"], strict=True)]
        found = {
            "site": [some(id=site, name=f"nation-{nation}", desc=f"Nation {nation}" if nation % 2 == 0 else None)],
            "wlangroup": [some(id="g0", site_id=site, name="G0"), some(id="g1", site_id=site)],
            "admin": [some(id="root", name="root", x_shadow="s", time_created=bson.Typed("int64", 1_700_000_000_000 + nation))],
            "user": [some(id=str(k), name=n if k % 3 else None, hostname=f"h{k}", mac=f"m{k}" if k % 5 == 0 else None, site_id=site if k % 7 else "nowhere") for k, n in rows],
            "wlanconf": [some(id=str(k), site_id=site, name=n, x_passphrase=f"p{k}", vlan=k, wlangroup_id="g0" if k % 20 == 0 else "none", more={"x_password": "s", "list": [{"secret": "t", "k": 1}]}, tags=["a", k]) for k, n in rows if k % 10 == 0],
            "extra": [{"k": nation}],
        }
        stream = b"".join(bson.encode({"collection": c}) + b"".join(map(bson.encode, docs)) for c, docs in found.items())
        out = io.BytesIO()
        with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
            for name, data in {"version": "9.5.21\r\n", "format": "8", "timestamp": "1713600000000", "system.properties": "dir=/opt/Service/data", "db.gz": gzip.compress(stream)}.items():
                z.writestr(name, data)
        return pd.DataFrame({"path": [f"nation-{nation}-{first // PART}"], "content": [out.getvalue()]})

    return dealt(t("customer").withColumn("part", F.expr(f"c_custkey div {PART}")), "c_nationkey", "part").groupBy("c_nationkey", "part").applyInPandas(pack, "path string, content binary")


def _contained(t) -> DataFrame:
    """The same archives, each inside an outer one."""
    import io
    import zipfile

    import pandas as pd

    def wrap(batches):
        for batch in batches:
            blobs = []
            for content in batch["content"]:
                out = io.BytesIO()
                with zipfile.ZipFile(out, "w") as z:
                    z.writestr("readme", "x")
                    z.writestr("net/Backup.UNF", bytes(content))
                blobs.append(out.getvalue())
            yield pd.DataFrame({"path": batch["path"], "content": blobs})

    return _backups(t).mapInPandas(wrap, "path string, content binary")


def _documents(t) -> DataFrame:
    return backup.documents(backup.scanned(backup.archives(_backups(t))))


@query(f"""SELECT {_PATH} AS path, CAST(c_custkey AS VARCHAR) AS id, CASE WHEN c_custkey % 7 = 0 THEN 'nowhere' ELSE {_SITE} END AS site_id, CASE WHEN c_custkey % 3 <> 0 THEN c_name END AS name,
  'h' || c_custkey AS hostname, CASE WHEN c_custkey % 5 = 0 THEN 'm' || c_custkey END AS mac FROM customer""")
def backup_end_to_end(t):
    """Archives of customers, read back: entries, stream, markers, typed records."""
    return backup.typed(_documents(t), "user").select("path", "id", "site_id", "name", "hostname", "mac")


@query(f"SELECT path, 'extra' AS collection, 1 AS n FROM {_ARCHIVES}")
def backup_opaque(t):
    return backup.opaque(_documents(t)).select("path", "collection", "n")


@query(f"SELECT path, 'extra' AS collection, '' AS id, '{{\"k\": ' || c_nationkey || '}}' AS body FROM {_ARCHIVES}")
def backup_opaque_records(t):
    return backup.opaque_records(_documents(t))


@query(f"SELECT path, 'extra(1)' AS summary FROM {_ARCHIVES}")
def backup_opaque_summary(t):
    return backup.opaque_summary(_documents(t))


@query(f"SELECT {_PATH} AS path, CAST(c_custkey AS VARCHAR) AS id, {_SITE} AS site_id, c_name AS name, 'p' || c_custkey AS x_passphrase, CAST(c_custkey AS INTEGER) AS vlan, CASE WHEN c_custkey % 20 = 0 THEN 'g0' ELSE 'none' END AS wlangroup_id {_WLANS}")
def backup_wlans(t):
    return backup.typed(_documents(t), "wlanconf").select("path", "id", "site_id", "name", "x_passphrase", "vlan", "wlangroup_id")


@query(f"SELECT path, site AS id, 'nation-' || c_nationkey AS name, CASE WHEN c_nationkey % 2 = 0 THEN 'Nation ' || c_nationkey END AS desc_text, CASE WHEN c_nationkey % 2 = 0 THEN 'Nation ' ELSE 'nation-' END || c_nationkey AS title FROM {_ARCHIVES}")
def backup_sites(t):
    return backup.typed(_documents(t), "site").select("path", "id", "name", F.col("desc").alias("desc_text"), "title")


@query(f"SELECT path, 'root' AS name, 1700000000000 + c_nationkey AS created FROM {_ARCHIVES}")
def backup_admins(t):
    return backup.typed(_documents(t), "admin").select("path", "name", F.unix_millis("time_created").alias("created"))


@query(f"""SELECT path, 'admin' AS collection, 'x_shadow' AS secret, 1 AS n FROM {_ARCHIVES}
  UNION ALL SELECT {_PATH}, 'wlanconf', s, count(*) {_WLANS.replace("WHERE", "CROSS JOIN (VALUES ('x_passphrase'), ('more.x_password'), ('more.list.secret')) v(s) WHERE")} GROUP BY 1, 2, 3""")
def backup_secrets(t):
    """Secret fields at any depth of the documents, counted by path."""
    return backup.secret_counts(_documents(t))


@query(f"""SELECT {_PATH} AS path, CAST(c_custkey AS VARCHAR) AS id, '{{"_id": "' || c_custkey || '", "more": {{"list": [{{"k": 1, "secret": "<redacted>"}}], "x_password": "<redacted>"}}, "name": "' || c_name || '", "site_id": {{"$oid": "' || {_SITE} || '"}}, "tags": ["a", ' || c_custkey
  || '], "vlan": ' || c_custkey || ', "wlangroup_id": "' || CASE WHEN c_custkey % 20 = 0 THEN 'g0' ELSE 'none' END || '", "x_passphrase": "<redacted>"}}' AS body {_WLANS}""")
def backup_redacted(t):
    return backup.typed(_documents(t), "wlanconf").select("path", "id", F.col("body_redacted").alias("body"))


@query(f"SELECT path, '9.5.21' AS version, '8' AS format, '2024-04-20T08:00:00' AS stamp, 'settingsOnly' AS kind, 'service' AS origin FROM {_ARCHIVES}")
def backup_identity(t):
    told = backup.identity(backup.scanned(backup.archives(_backups(t))), [("/data/service", "appliance"), ("/opt/service", "service")])
    return told.select("path", "version", "format", F.date_format("timestamp", "yyyy-MM-dd'T'HH:mm:ss").alias("stamp"), "kind", "origin")


def _diagnostics(t) -> DataFrame:
    found = stored(backup.archives(_backups(t)), "archives")
    return backup.diagnostics(found, stored(backup.scanned(found), "scan"))


@query(f"SELECT path, 2 AS infos, 0 AS problems, 0 AS worst FROM {_ARCHIVES}")
def backup_badges(t):
    return backup.severity_badge(_diagnostics(t))


@query(f"SELECT path, unnest(['- [info] `unknownCollection` extra(1)', '- [info] `settingsOnlyDetected` no statistics']) AS line FROM {_ARCHIVES}")
def backup_report(t):
    return backup.report(_diagnostics(t), infos=True)


@query(f"SELECT {_PATH} AS path, count(*) AS users FROM customer GROUP BY 1")
def backup_container(t):
    """Backups inside outer archives."""
    return backup.typed(backup.documents(backup.scanned(backup.opened(_contained(t)))), "user").groupBy("path").agg(F.count("*").alias("users"))


@query(f"SELECT path, name FROM {_ARCHIVES}, (VALUES ('version'), ('format'), ('timestamp'), ('system.properties'), ('db.gz')) v(name)")
def backup_entries(t):
    return backup.inventory(backup.scanned(backup.archives(_backups(t)))).select("path", "name")


@query(f"""SELECT {_PATH} AS path, 1 AS sites, 0 AS devices, count(*) FILTER (c_custkey % 10 = 0) AS wlans, 0 AS networks, 0 AS rules, 1 AS admins, 1 + 3 * count(*) FILTER (c_custkey % 10 = 0) AS secrets FROM customer GROUP BY 1""")
def backup_overview(t):
    return backup.overview(_documents(t))


_TREE = f"""
SELECT path, 'cat:' || c AS node_id, CAST(NULL AS VARCHAR) AS parent_id, 'category' AS kind, n AS title FROM {_ARCHIVES}, (VALUES ('sites', 'Sites'), ('admins', 'Admins'), ('opaque', 'Other Collections')) v(c, n)
UNION ALL SELECT path, 'site:' || site, 'cat:sites', 'site', CASE WHEN c_nationkey % 2 = 0 THEN 'Nation ' ELSE 'nation-' END || c_nationkey FROM {_ARCHIVES}
UNION ALL SELECT path, 'sitechild:' || site || ':wlans', 'site:' || site, 'siteChildCategory', 'WLANs' FROM {_ARCHIVES}
UNION ALL SELECT DISTINCT {_PATH}, 'sitechild:' || {_SITE} || ':clients', 'site:' || {_SITE}, 'siteChildCategory', 'Clients' FROM customer WHERE c_custkey % 7 <> 0
UNION ALL SELECT path, 'wlangroup:' || g, 'sitechild:' || site || ':wlans', 'wlanGroup', n FROM {_ARCHIVES}, (VALUES ('g0', 'G0'), ('g1', 'Group')) v(g, n)
UNION ALL SELECT {_PATH}, 'wlan:' || c_custkey, CASE WHEN c_custkey % 20 = 0 THEN 'wlangroup:g0' ELSE 'sitechild:' || {_SITE} || ':wlans' END, 'wlan', c_name {_WLANS}
UNION ALL SELECT {_PATH}, 'client:' || c_custkey, 'sitechild:' || {_SITE} || ':clients', 'client',
  concat_ws(' \u00b7 ', CASE WHEN c_custkey % 3 <> 0 THEN c_name END, 'h' || c_custkey, CASE WHEN c_custkey % 5 = 0 THEN 'm' || c_custkey END) FROM customer WHERE c_custkey % 7 <> 0
UNION ALL SELECT path, 'admin:root', 'cat:admins', 'admin', 'root' FROM {_ARCHIVES}
UNION ALL SELECT path, 'opcoll:extra', 'cat:opaque', 'opaqueCollection', 'extra' FROM {_ARCHIVES}
UNION ALL SELECT path, 'oprec:extra:', 'opcoll:extra', 'opaqueRecord', '(no id)' FROM {_ARCHIVES}
"""


@query(_TREE)
def backup_nodes(t):
    return backup_tree.nodes(_documents(t)).select("path", "node_id", "parent_id", "kind", "title")


@query(f"SELECT path, substr(parent_id, 5) AS category, count(*) AS badge FROM ({_TREE}) WHERE parent_id LIKE 'cat:%' GROUP BY 1, 2")
def backup_category_badges(t):
    return backup_tree.badges(backup_tree.nodes(_documents(t)))


@query(f"""SELECT {_PATH} AS path, 'wlan:' || c_custkey AS ord, 'WLAN: ' || c_name || chr(10) || '  _id: ' || c_custkey || chr(10) || '  site_id: ' || {_SITE} || chr(10) || '  name: ' || c_name || chr(10) || '  x_passphrase: <redacted>' || chr(10) || '  vlan: ' || c_custkey
  || chr(10) || '  wlangroup_id: ' || CASE WHEN c_custkey % 20 = 0 THEN 'g0' ELSE 'none' END || chr(10) || '  more: {{x_password, list}}' || chr(10) || '  tags: [a, ' || c_custkey || ']' AS body {_WLANS}""")
def backup_text(t):
    """Sections of a backup's nodes as text, secrets replaced."""
    found = backup_tree.sections(backup_tree.nodes(_documents(t))).filter("tag = 'wlan'")
    return export.as_text(found.withColumn("ord", F.struct("path", "node_id"))).select("ord.path", F.col("ord.node_id").alias("ord"), "body")


@query(f"SELECT path, count(*) AS selected FROM ({_TREE}) WHERE kind NOT IN ('category', 'siteChildCategory', 'wlanGroup', 'opaqueCollection') GROUP BY 1")
def backup_selection_count(t):
    return backup_tree.sections(backup_tree.nodes(_documents(t))).groupBy("path").agg(F.count("*").alias("selected"))
