"""URL filters: rules for hosts and path beginnings, and a path-template tree for all other urls.

The tree is kept as a table of (host, template) with counts, a template being all the
segments of a path. Segments are generalised into wildcards by their shape (numbers, long
hexadecimal names, dates), and then, level by level, where a node has so many different children
that few urls share one. Branches that differ in one segment only are merged where both a branch and the rest of them have
EVIDENCE labels and their shares of bad pages don't differ by more than chance; a branch without
labels of its own stays by itself and leans on its host. Levels where no host
has urls enough to generalise, or two templates to merge, are passed over. A template's
purity is its smoothed share of bad labels: with few labels it leans on its host's share, and
that on the share of all pages. Templates at or over REJECT are blocked.

All of it is DataFrame functions: grouping with map-side combining, and equi-joins of tables that
hold a row for each template.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import pick, written

MANY = 20  # different children that make a node's segment variable,
SHARE = 0.2  # if a child holds less than this share of MANY urls on average
LEAN = 20.0  # labels that a host's or the corpus' share counts for
ALIKE = 1.96
EVIDENCE = 5  # labels that a branch and the rest of its siblings have at least, if they are merged
REJECT = 0.5
#: Rules are compared as one expression, so their number is bounded; longer lists belong in the labels.
MAX_RULES = 1000
#: Rules that judge() goes by unless it is given others, as the registered query does: (action, host and path).
RULES = (("block", "com/en/"), ("allow", "example.com/en/7"), ("block", "net/de/"), ("allow", "example.net/de/8"), ("block", "org/es/"))
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    """After the first :// up to / ? # or the end, with A-Z in lower case; else empty."""
    after = F.substring(url, F.instr(url, "://") + 3, F.length(url))
    return F.when(F.instr(url, "://") > 0, F.translate(F.regexp_extract(after, r"^[^/?#]*", 0), _UPPER, _LOWER)).otherwise(F.lit(""))


def path_of(url: Column) -> Column:
    """What follows the host up to ? # or the end."""
    after = F.substring(url, F.instr(url, "://") + 3, F.length(url))
    return F.when(F.instr(url, "://") > 0, F.regexp_extract(after, r"^[^/?#]*([^?#]*)", 1)).otherwise(F.lit(""))


def ruled(host: Column, path: Column, rules) -> Column:
    """The longest rule that fits, as struct(size, rule, action); null if none does."""
    if len(rules) > MAX_RULES:
        raise ValueError(f"more than {MAX_RULES} rules")
    found = F.lit(None).cast("struct<size:int,rule:string,action:string>")
    for action, rule in sorted(rules, key=lambda r: (len(r[1]), r[1])):
        of_host, slash, rest = rule.partition("/")
        fits = ((host == of_host) | host.endswith("." + of_host)) & path.startswith(slash + rest)
        found = F.when(fits, F.struct(F.lit(len(rule)).alias("size"), F.lit(rule).alias("rule"), F.lit(action).alias("action"))).otherwise(found)
    return found


def _shaped(segment: Column) -> Column:
    """A segment whose shape says that it varies becomes a wildcard; an extension stays."""
    out = F.regexp_replace(segment, r"^[0-9]+(\.[A-Za-z]{1,5})?$", "*$1")
    out = F.regexp_replace(out, r"^[0-9A-Fa-f-]*[0-9][0-9A-Fa-f-]{6,}(\.[A-Za-z]{1,5})?$", "*$1")
    return F.regexp_replace(out, r"^[0-9]{1,4}([-_.][0-9]{1,4})+$", "*")


def templates_of(path: Column) -> Column:
    """All segments by shape."""
    return F.transform(F.filter(F.split(path, "/"), lambda x: x != ""), _shaped)


def tree(urls: DataFrame) -> DataFrame:
    """(host, shape, purity, template) of urls (host, shape, bad): bad is 1, 0 or null for unlabelled."""
    rows = urls.groupBy("host", "shape").agg(F.count("*").alias("n"), F.count("bad").alias("labels"), F.coalesce(F.sum("bad"), F.lit(0)).alias("bad"))
    rows = written(rows.withColumn("template", F.col("shape")), "url-shapes")
    at = lambda c, k: F.get(c, k)
    put = lambda c, k: F.transform(c, lambda x, i: F.when(i == k, F.lit("*")).otherwise(x))
    # a node with MANY children needs as many templates of its host that are deeper
    deeper = Window.partitionBy("host").orderBy(F.desc("size"))
    sizes = rows.groupBy("host", F.size("template").alias("size")).agg(F.count("*").alias("n")).withColumn("n", F.sum("n").over(deeper))
    for k in range(sizes.filter(F.col("n") >= MANY).agg(F.coalesce(F.max("size"), F.lit(0))).first()[0]):
        node = F.slice("template", 1, k)
        children = rows.filter(F.size("template") > k).groupBy("host", node.alias("node"), at(F.col("template"), k).alias("child")).agg(F.sum("n").alias("n"))
        wide = children.groupBy("host", "node").agg(F.count("*").alias("different"), F.sum("n").alias("n")).filter((F.col("different") >= MANY) & (F.col("n") < F.col("different") * MANY * SHARE)).select(F.col("host").alias("_host"), F.col("node").alias("_node"))
        wide = written(wide, "url-nodes")
        if wide.isEmpty():
            continue
        rows = rows.join(wide, (F.col("host") == F.col("_host")) & (node == F.col("_node")) & (F.size("template") > k), "left")
        rows = rows.withColumn("template", F.when(F.col("_host").isNotNull(), put(F.col("template"), k)).otherwise(F.col("template"))).drop("_host", "_node")
        rows = written(rows, "url-templates")
    k = None
    while True:
        # a template that no other of its host and size is left to merge with is like its pools at all levels
        lone = rows.groupBy(F.col("host").alias("_h"), F.size("template").alias("_size")).agg((F.min("template") == F.max("template")).alias("_lone"))
        lone = written(lone, "url-sizes")
        top = lone.filter("NOT _lone").agg(F.coalesce(F.max("_size"), F.lit(0))).first()[0]
        k = top - 1 if k is None else min(top, k) - 1
        if k < 0:
            break
        own = rows.groupBy("host", "template").agg(F.sum("labels").alias("own_labels"), F.sum("bad").alias("own_bad"))
        pooled = own.filter(F.size("template") > k).groupBy("host", put(F.col("template"), k).alias("pool")).agg(F.sum("own_labels").alias("labels"), F.sum("own_bad").alias("bad"))
        a = own.select(F.col("host").alias("_h"), F.col("template").alias("_t"), "own_labels", "own_bad", put(F.col("template"), k).alias("_pool"))
        b = pooled.select(F.col("host").alias("_ph"), F.col("pool").alias("_pp"), F.col("labels").alias("pool_labels"), F.col("bad").alias("pool_bad"))
        rest, rest_bad = F.col("pool_labels") - F.col("own_labels"), F.col("pool_bad") - F.col("own_bad")
        share = (F.col("pool_bad") + 0.5) / (F.col("pool_labels") + 1)
        known = F.least(F.col("own_labels"), rest) >= EVIDENCE
        apart = F.when(known, F.abs(F.col("own_bad") / F.col("own_labels") - rest_bad / rest) / F.sqrt(share * (1 - share) * (1 / F.col("own_labels") + 1 / rest)))
        like = a.join(b, (F.col("_h") == F.col("_ph")) & (F.col("_pool") == F.col("_pp"))).filter(apart <= ALIKE).select("_h", "_t", "_pool")
        rows = rows.join(like, (F.col("host") == F.col("_h")) & (F.col("template") == F.col("_t")), "left")
        rows = written(rows.withColumn("template", F.coalesce("_pool", "template")).drop("_h", "_t", "_pool"), "url-templates")
    rows = rows.join(lone, (F.col("host") == F.col("_h")) & (F.size("template") == F.col("_size")))
    rows = written(rows.withColumn("template", F.when(F.col("_lone"), F.transform("template", lambda x: F.lit("*"))).otherwise(F.col("template"))).drop("_h", "_size", "_lone"), "url-templates")
    every = rows.agg(F.coalesce(F.sum("bad"), F.lit(0)).alias("all_bad"), F.coalesce(F.sum("labels"), F.lit(0)).alias("all_labels"))
    hosts = rows.groupBy(F.col("host").alias("_h")).agg(F.sum("bad").alias("host_bad"), F.sum("labels").alias("host_labels"))
    nodes = rows.groupBy(F.col("host").alias("_th"), F.col("template").alias("_t")).agg(F.sum("bad").alias("node_bad"), F.sum("labels").alias("node_labels"))
    base = (F.col("all_bad") + 1) / (F.col("all_labels") + LEAN)
    by_host = (F.col("host_bad") + LEAN * base) / (F.col("host_labels") + LEAN)
    purity = (F.col("node_bad") + LEAN * by_host) / (F.col("node_labels") + LEAN)
    judged = nodes.join(hosts, F.col("_th") == F.col("_h")).join(F.broadcast(every)).select("_th", "_t", purity.alias("purity"))
    return rows.join(judged, (F.col("host") == F.col("_th")) & (F.col("template") == F.col("_t"))).select("host", "shape", "template", "purity")


def judge(pages: DataFrame, labels: DataFrame, rules=RULES, reject: float = REJECT) -> DataFrame:
    """(page_id, host, path, rule, verdict, template, bad_share) of every row of pages (page_id, url).

    labels (doc_id, quality, toxic): a page whose label of either kind is bad (quality 0 or toxic 1)
    is bad. The longest rule that fits decides; without one, the template does. Null urls and urls
    without :// have an empty host and path, and one template. Repeated labels of a page count as
    the worst of them. Without labels nothing but rules blocks.
    """
    urls = pick(pages, page_id="long", url="string")
    urls = urls.select("page_id", F.coalesce(host_of(F.col("url")), F.lit("")).alias("host"), F.coalesce(path_of(F.col("url")), F.lit("")).alias("path"))
    urls = urls.withColumn("shape", templates_of(F.col("path")))
    known = pick(labels, doc_id="long", quality="int", toxic="int").groupBy(F.col("doc_id").alias("_id")).agg(F.max(F.when((F.col("quality") == 0) | (F.col("toxic") == 1), 1).otherwise(F.when(F.col("quality").isNotNull() | F.col("toxic").isNotNull(), 0))).alias("bad"))
    seen = urls.join(known, F.col("page_id") == F.col("_id"), "left").select("host", "shape", "bad")
    judged = tree(seen).select(F.col("host").alias("_host"), F.col("shape").alias("_shape"), F.array_join("template", "/").alias("template"), "purity")
    rule = ruled(F.col("host"), F.col("path"), rules)
    out = urls.join(judged, (F.col("host") == F.col("_host")) & (F.col("shape") == F.col("_shape")), "left").withColumn("_rule", rule)
    by_tree = F.when(F.coalesce(F.col("purity"), F.lit(0.0)) >= reject, "block").otherwise("allow")
    return out.select("page_id", "host", "path", F.col("_rule.rule").alias("rule"), F.coalesce(F.col("_rule.action"), by_tree).alias("verdict"), "template", F.round("purity", 6).alias("bad_share"))
