"""The tree of a backup as a flat table of nodes in outline order, selections of it, searches, and references.

Each row is a node with a key that sorts nodes of an archive in the order of the outline (a parent before what is below it, siblings by
the rank of their category, then by their place in the archive): a part of fixed width for each level, so that
a node's subtree is the range of keys that begin with its own. Sites hold categories of their own records, the other categories
stand beside the sites. Site-scoped records without a known site are no nodes; those of two sites of one id stand below both.
Groups and categories have no document.

Documents are projected once and stored; what follows reads narrow columns of that table.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.functions.text import matches
from lodestone.sources.backup import SPECS, field, field_text
from lodestone.sources.store import stored

DOT = " · "
#: The order of collections that share a category of a site.
BESIDE = {"firewallgroup": "1", "portforward": "2", "routing": "3"}
# Collection, node kind, id prefix, category, section tag, title columns, title without them, in tree order.
OF_SITE = (
    ("device", "device", "device", "devices", "device", ("name", "mac", "model"), ""),
    ("wlangroup", "wlanGroup", "wlangroup", "wlans", "wlan_group", ("name",), "Group"),
    ("wlanconf", "wlan", "wlan", "wlans", "wlan", ("name",), "(unnamed)"),
    ("networkconf", "network", "network", "networks", "network", ("name", "ip_subnet"), ""),
    ("firewallrule", "firewallRule", "fwrule", "firewall", "firewall_rule", ("ruleset", "name"), ""),
    ("firewallgroup", "firewallGroup", "fwgroup", "firewall", "firewall_group", ("group_type", "name"), ""),
    ("portforward", "portForward", "pf", "firewall", "port_forward", ("name",), "(unnamed)"),
    ("routing", "routing", "rt", "firewall", "routing", ("name",), "(unnamed route)"),
    ("portconf", "portProfile", "pp", "portProfiles", "port_profile", ("name",), "(unnamed)"),
    ("user", "client", "client", "clients", "client", ("name", "hostname", "mac"), ""),
    ("setting", "setting", "set", "settings", "setting", ("key",), "(setting)"),
)
OF_ALL = (
    ("admin", "admin", "admin", "admins", "admin", ("name", "email"), ""),
    ("radiusprofile", "radius", "radius", "radius", "radius_profile", ("name",), "(profile)"),
    ("hotspotop", "hotspotOp", "hsop", "hotspot", "hotspot_operator", ("name",), "(op)"),
    ("account", "account", "acct", "accounts", "account", ("name",), "(account)"),
)
CATEGORIES = {"sites": "Sites", "admins": "Admins", "radius": "RADIUS Profiles", "hotspot": "Hotspot Operators", "accounts": "Accounts", "opaque": "Other Collections"}
SITE_CATEGORIES = {"devices": "Devices", "wlans": "WLANs", "networks": "Networks", "firewall": "Firewall", "portProfiles": "Port Profiles", "clients": "Clients", "settings": "Settings"}
#: Relationships between collections: collection (None: any), path of the field ([] for each item of an array), collection that it names.
REFERENCES = (
    (None, "site_id", "site"),
    ("device", "port_overrides[].portconf_id", "portconf"),
    ("device", "wlangroup_id", "wlangroup"),
    ("wlanconf", "wlangroup_id", "wlangroup"),
    ("wlanconf", "usergroup_id", "usergroup"),
    ("user", "usergroup_id", "usergroup"),
    ("user", "network_id", "networkconf"),
    ("firewallrule", "src_firewallgroup_ids[]", "firewallgroup"),
    ("firewallrule", "dst_firewallgroup_ids[]", "firewallgroup"),
    ("portconf", "native_networkconf_id", "networkconf"),
    ("portconf", "voice_networkconf_id", "networkconf"),
    ("privilege", "admin_id", "admin"),
    ("dpigroup", "dpiapp_ids[]", "dpiapp"),
)
# The symbols of categories and kinds.
CATEGORY_SYMBOLS = {"cat:sites": "house", "cat:admins": "person.badge.key", "cat:radius": "key", "cat:hotspot": "ticket", "cat:accounts": "person.crop.circle.badge.questionmark", "cat:opaque": "tray.full"}
CHILD_SYMBOLS = {"Devices": "antenna.radiowaves.left.and.right", "WLANs": "wifi", "Networks": "network", "Firewall": "shield", "Port Profiles": "rectangle.stack", "Clients": "person.2", "Settings": "slider.horizontal.3"}
SYMBOLS = {
    "site": "house", "device": "antenna.radiowaves.left.and.right", "wlanGroup": "wifi.square", "wlan": "wifi", "network": "network", "firewallGroup": "shield.lefthalf.filled", "firewallRule": "shield", "portForward": "arrow.forward.to.line", "portProfile": "rectangle.stack",
    "routing": "arrow.triangle.branch", "client": "person", "admin": "person.badge.key", "account": "person.crop.circle.badge.questionmark", "radius": "key", "hotspotOp": "ticket", "setting": "slider.horizontal.3", "opaqueCollection": "tray.full", "opaqueRecord": "doc.text",
}
COLUMNS = ("path", "key", "depth", "node_id", "parent_id", "kind", "title", "tag", "fields", "body", "body_redacted")
_NONE = {"tag": "string", "fields": None, "body": "string", "body_redacted": "string"}


def _choice(values: dict[str, str | int], of: Column) -> Column:
    return F.element_at(F.create_map(*[F.lit(x) for pair in values.items() for x in pair]), of)


def _title(columns: tuple[str, ...], default: str) -> Column:
    """Several fields joined by a dot, without the missing ones; of one field, itself or the default."""
    found = [field_text(c) for c in columns]
    return F.concat_ws(DOT, *found) if len(found) > 1 else F.coalesce(found[0], F.lit(default))


def placed(docs: DataFrame) -> DataFrame:
    """(path, collection, id, at, site_id, group_id, title, fields, body, body_redacted) of documents, stored: what their nodes are made of.

    at is a document's place in its archive as text of fixed width.
    """
    at = F.concat(F.lpad(F.hex("seq"), 6, "0"), F.lpad(F.hex("offset"), 12, "0"))
    own = {c: _title(names, default) for c, _, _, _, _, names, default in (*OF_SITE, *OF_ALL)} | {"site": F.coalesce(field_text("desc"), field_text("name"), F.lit(""))}
    title = reduce(lambda rest, pair: F.when(F.col("collection") == pair[0], pair[1]).otherwise(rest), own.items(), F.when(F.col("id") == "", "(no id)").otherwise(F.col("id")))
    site = F.coalesce(field("site_id", "objectId", "string"), F.lit(""))
    rows = docs.select("path", "collection", "id", at.alias("at"), site.alias("site_id"), field("wlangroup_id", "objectId", "string").alias("group_id"), title.alias("title"), "fields", "body", "body_redacted")
    return stored(rows, "tree-documents")


def nodes(docs: DataFrame, lone_routes: bool = False) -> DataFrame:
    """COLUMNS of every node of the documents of backups.

    Routes count only where the site has rules, groups or forwards as well, unless lone_routes. A null site counts as an
    empty one. Archives without documents have no nodes.
    """
    rows = placed(docs)
    document = [F.col(c) for c in ("fields", "body", "body_redacted")]
    kinds = dict(rows.dtypes)
    bare = lambda df, **columns: df.select("path", *(c.alias(n) for n, c in columns.items()), *(F.lit(None).cast(t or kinds[c]).alias(c) for c, t in _NONE.items()))
    node = lambda df, **columns: df.select("path", *(c.alias(n) for n, c in columns.items()), *document)
    text = lambda *parts: F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])
    none = F.lit(None).cast("string")
    part = {c: i for i, c in enumerate(CATEGORIES)}

    sites = rows.filter("collection = 'site'")
    home = sites.select(F.col("path").alias("_path"), F.col("id").alias("_site"), text("0/", F.col("at")).alias("_home"))
    own = {c: x for c, *x in OF_SITE}
    of_site = rows.filter(F.col("collection").isin(*own)).join(home, (F.col("path") == F.col("_path")) & (F.col("site_id") == F.col("_site"))).drop("_path", "_site")
    category = _choice({c: x[2] for c, x in own.items()}, F.col("collection"))
    of_site = of_site.withColumn("category", category)
    rank = _choice({c: str(i) for i, c in enumerate(SITE_CATEGORIES)}, F.col("category"))
    inside = of_site.groupBy("path", "_home", "site_id", "category").agg(F.bool_or(F.col("collection") != "routing").alias("_shown")).filter(F.lit(lone_routes) | F.col("_shown"))
    if not lone_routes:
        shown = inside.filter("category = 'firewall'").select(F.col("path").alias("_p"), F.col("_home").alias("_h"))
        routes = of_site.filter("collection = 'routing'").join(shown, (F.col("path") == F.col("_p")) & (F.col("_home") == F.col("_h")), "left_semi")
        of_site = of_site.filter("collection <> 'routing'").unionByName(routes)
    # networks of a group stand below it, the others of the site behind the groups
    groups = of_site.filter("collection = 'wlangroup'").select(F.col("path").alias("_p"), F.col("_home").alias("_h"), F.col("id").alias("_g"), F.col("at").alias("_at"))
    wlans = of_site.filter("collection = 'wlanconf'").join(groups, (F.col("path") == F.col("_p")) & (F.col("_home") == F.col("_h")) & (F.col("group_id") == F.col("_g")), "left")
    others = of_site.filter("collection <> 'wlanconf'")
    order = F.coalesce(_choice(BESIDE, F.col("collection")), F.lit("0"))
    below = text(F.col("_home"), "/", rank)
    category_id = text("sitechild:", F.col("site_id"), ":", F.col("category"))
    node_id = text(_choice({c: x[1] for c, x in own.items()}, F.col("collection")), ":", F.col("id"))
    kind, tag = (_choice({c: x[k] for c, x in own.items()}, F.col("collection")) for k in (0, 3))
    grouped = F.col("_at").isNotNull()
    parts = [
        node(sites, key=text("0/", F.col("at")), node_id=text("site:", F.col("id")), parent_id=F.lit("cat:sites"), kind=F.lit("site"), title=F.col("title"), tag=F.lit("site")),
        bare(inside, key=below, node_id=category_id, parent_id=text("site:", F.col("site_id")), kind=F.lit("siteChildCategory"), title=_choice(SITE_CATEGORIES, F.col("category"))),
        node(wlans, key=F.when(grouped, text(below, "/0.", F.col("_at"), "/", F.col("at"))).otherwise(text(below, "/1.", F.col("at"))), node_id=node_id, parent_id=F.when(grouped, text("wlangroup:", F.col("_g"))).otherwise(category_id), kind=kind, title=F.col("title"), tag=tag),
        node(others.filter("collection <> 'wlangroup'"), key=text(below, "/", order, ".", F.col("at")), node_id=node_id, parent_id=category_id, kind=kind, title=F.col("title"), tag=tag),
        bare(others.filter("collection = 'wlangroup'"), key=text(below, "/", order, ".", F.col("at")), node_id=node_id, parent_id=category_id, kind=kind, title=F.col("title")),
    ]
    wide = {c: x for c, *x in OF_ALL}
    category = _choice({c: x[2] for c, x in wide.items()}, F.col("collection"))
    parts.append(node(rows.filter(F.col("collection").isin(*wide)), key=text(_choice({c: str(part[x[2]]) for c, x in wide.items()}, F.col("collection")), "/", F.col("at")), node_id=text(_choice({c: x[1] for c, x in wide.items()}, F.col("collection")), ":", F.col("id")), parent_id=text("cat:", category), kind=_choice({c: x[0] for c, x in wide.items()}, F.col("collection")), title=F.col("title"), tag=_choice({c: x[3] for c, x in wide.items()}, F.col("collection"))))
    known = [*SPECS]
    opaque = rows.filter(~F.col("collection").isin(*known))
    firsts = opaque.groupBy("path", "collection").agg(F.min("at").alias("at"))
    first = firsts.select(F.col("path").alias("_p"), F.col("collection").alias("_c"), F.col("at").alias("_first"))
    records = opaque.join(first, (F.col("path") == F.col("_p")) & (F.col("collection") == F.col("_c")))
    up, rank = text("opcoll:", F.col("collection")), f"{part['opaque']}/"
    parts.append(bare(firsts, key=text(rank, F.col("at")), node_id=up, parent_id=F.lit("cat:opaque"), kind=F.lit("opaqueCollection"), title=F.col("collection")))
    parts.append(node(records, key=text(rank, F.col("_first"), "/", F.col("at")), node_id=text("oprec:", F.col("collection"), ":", F.col("id")), parent_id=up, kind=F.lit("opaqueRecord"), title=F.col("title"), tag=F.col("collection")))
    category = F.coalesce(_choice({"site": "sites"} | {c: x[2] for c, x in wide.items()}, F.col("collection")), F.when(~F.col("collection").isin(*known), "opaque"))
    tops = rows.select("path", category.alias("category")).filter("category IS NOT NULL").distinct()
    parts.append(bare(tops, key=_choice({c: str(i) for c, i in part.items()}, F.col("category")), node_id=text("cat:", F.col("category")), parent_id=none, kind=F.lit("category"), title=_choice(CATEGORIES, F.col("category"))))
    out = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
    return out.withColumn("depth", F.length("key") - F.length(F.replace("key", F.lit("/")))).select(*COLUMNS)


def symbol() -> Column:
    """The name of a node's symbol."""
    return F.when(F.col("kind") == "category", _choice(CATEGORY_SYMBOLS, F.col("node_id"))).when(F.col("kind") == "siteChildCategory", _choice(CHILD_SYMBOLS, F.col("title"))).otherwise(_choice(SYMBOLS, F.col("kind")))


def scope(tree: DataFrame, category: str | None = None) -> DataFrame:
    """The nodes at the top of an outline: the children of one category, or those of all."""
    return tree.filter((F.col("depth") == 1) & (F.lit(category is None) | (F.col("parent_id") == f"cat:{category}")))


def lookup(tree: DataFrame, wanted: DataFrame) -> DataFrame:
    """For each (path, node_id) wanted the first node of that id in the order of the outline, which may stand in several places."""
    asked = wanted.select(F.col("path").alias("_p"), F.col("node_id").alias("_n")).distinct()
    hits = tree.join(asked, (F.col("path") == F.col("_p")) & (F.col("node_id") == F.col("_n")), "left_semi")
    first = hits.groupBy(F.col("path").alias("_p"), F.col("node_id").alias("_n")).agg(F.min("key").alias("_k"))
    return hits.join(first, (F.col("path") == F.col("_p")) & (F.col("node_id") == F.col("_n")) & (F.col("key") == F.col("_k"))).drop("_p", "_n", "_k")


def children(tree: DataFrame, nodes: DataFrame) -> DataFrame:
    """The nodes right below nodes (path, key), in their order: those whose key has one part more."""
    up = nodes.select(F.col("path").alias("_p"), F.col("key").alias("_k")).distinct()
    return tree.join(up, (F.col("path") == F.col("_p")) & (F.regexp_replace("key", "/[^/]*$", "") == F.col("_k")) & (F.col("depth") > 0), "left_semi")


def collections(docs: DataFrame) -> DataFrame:
    """(path, collection, n, place): the collections of each backup in the order in which they are met."""
    counts = docs.groupBy("path", "collection").agg(F.count("*").alias("n"), F.min(F.struct("seq", "offset")).alias("first"))
    return counts.withColumn("place", F.row_number().over(Window.partitionBy("path").orderBy("first"))).drop("first")


def badges(tree: DataFrame) -> DataFrame:
    """(path, category, badge): the direct children of each category at the top."""
    return tree.filter(F.col("parent_id").startswith("cat:")).groupBy("path", F.substring("parent_id", 5, 100).alias("category")).agg(F.count("*").alias("badge"))


def _ancestors() -> Column:
    """The keys above a node's key, and itself; a tree has five levels."""
    parts = F.split("key", "/")
    return F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, 1, n), "/"))


def _keyed(tree: DataFrame, keys: DataFrame) -> DataFrame:
    """The nodes of a tree whose (path, key) is among keys, once each."""
    keys = keys.select(F.col("path").alias("_path"), F.col("key").alias("_key")).distinct()
    return tree.join(keys, (F.col("path") == F.col("_path")) & (F.col("key") == F.col("_key")), "left_semi")


def selected(tree: DataFrame, selection: DataFrame) -> DataFrame:
    """The nodes of a selection (path, node_id) and all below them, once each.

    Each node asks for its own key and those above it, so that a selection of any size is two joins of keys and no search of ranges.
    """
    chosen = selection.select(F.col("path").alias("_p"), F.col("node_id").alias("_n")).distinct()
    tops = tree.join(chosen, (F.col("path") == F.col("_p")) & (F.col("node_id") == F.col("_n")), "left_semi").select(F.col("path").alias("_p"), F.col("key").alias("_top")).distinct()
    asked = tree.select("path", "key", F.explode(_ancestors()).alias("_up"))
    return _keyed(tree, asked.join(tops, (F.col("path") == F.col("_p")) & (F.col("_up") == F.col("_top")), "left_semi"))


def toggled(tree: DataFrame, selection: DataFrame, node: DataFrame, on: bool) -> DataFrame:
    """The selection (path, node_id) after nodes (path, node_id) and all below them are switched on or off."""
    touched, own = selected(tree, node).select("path", "node_id"), selection.select("path", "node_id")
    return own.unionByName(touched).distinct() if on else own.distinct().join(touched, ["path", "node_id"], "left_anti")


def found(tree: DataFrame, query: str) -> DataFrame:
    """The nodes whose title or a field's name or value holds the query in any case, and those above them, with hit telling which is which.

    Nested documents are seen as the names of their fields, long arrays as their length. An empty query finds all.
    """
    fields = F.exists(F.coalesce("fields", F.array().cast(dict(tree.dtypes)["fields"])), lambda f: matches(query, f["key"], f["display"]))
    hits = tree.select("path", "key", (matches(query, F.col("title")) | fields).alias("hit")).filter("hit")
    keys = hits.select("path", F.explode(_ancestors()).alias("key"))
    own = hits.select(F.col("path").alias("_p"), F.col("key").alias("_k"), "hit")
    return _keyed(tree, keys).join(own, (F.col("path") == F.col("_p")) & (F.col("key") == F.col("_k")), "left").withColumn("hit", F.coalesce("hit", F.lit(False))).drop("_p", "_k")


def sections(tree: DataFrame, secrets: bool = False) -> DataFrame:
    """(path, key, node_id, tag, title, fields, raw) of the nodes that have a document; secret values are replaced unless asked for.

    Which fields are secret is told when archives are scanned, of fields and raw alike.
    """
    value = lambda f: F.when(f["secret"], f["display" if secrets else "pretty"]).otherwise(f["pretty"])
    fields = F.transform("fields", lambda f: F.struct(f["key"].alias("key"), value(f).alias("value")))
    return tree.filter("body IS NOT NULL").select("path", "key", "node_id", "tag", "title", fields.alias("fields"), F.col("body" if secrets else "body_redacted").alias("raw"))


def _ids(path: str) -> Column:
    """The ids that stand at a path of a document: strings and object ids, of arrays those of each item."""
    text = lambda v: F.when(F.schema_of_variant(v) == "STRING", v.cast("string")).otherwise(F.try_variant_get(v, "$['$oid']", "string"))
    body = F.try_parse_json("body")
    if "[]" not in path:
        return F.array(F.coalesce(field(path, "objectId", "string")))
    name, _, rest = path.partition("[]")
    items = F.try_variant_get(body, f"$.{name}", "array<variant>")
    inner = rest.lstrip(".")
    return F.transform(items, lambda x: text(F.try_variant_get(x, f"$.{inner}", "variant") if inner else x))


def references(docs: DataFrame, relations: tuple = REFERENCES) -> DataFrame:
    """(path, collection, id, field, item, target, target_id, found): each id that documents name in others, and whether its document is there.

    All relations are taken in one pass over the documents and met with their targets by one join within each archive; null and
    empty ids are none. Repeated targets count once.
    """
    none = F.array().cast("array<struct<field:string,item:int,target:string,target_id:string>>")

    def named(collection: str | None, path: str, target: str) -> Column:
        mine = F.lit(True) if collection is None else F.col("collection") == collection
        found = F.transform(F.when(mine, _ids(path)), lambda x, i: F.struct(F.lit(path).alias("field"), i.cast("int").alias("item"), F.lit(target).alias("target"), x.alias("target_id")))
        return F.coalesce(F.filter(found, lambda r: F.coalesce(r["target_id"] != "", F.lit(False))), none)

    refs = [named(*r) for r in relations]
    rows = docs.select("path", "collection", "id", F.explode(F.concat(*refs)).alias("r")).select("path", "collection", "id", "r.*")
    there = docs.filter(F.col("collection").isin(*{t for _, _, t in relations})).select(F.col("path").alias("_p"), F.col("collection").alias("_c"), F.col("id").alias("_id")).distinct().withColumn("found", F.lit(True))
    met = rows.join(there, (F.col("path") == F.col("_p")) & (F.col("target") == F.col("_c")) & (F.col("target_id") == F.col("_id")), "left")
    return met.withColumn("found", F.coalesce("found", F.lit(False))).drop("_p", "_c", "_id")


def equal_documents(docs: DataFrame) -> DataFrame:
    """(path, collection, id, other_path, other_id) of documents that are equal to the first one with the same fields in the same order, over all archives.

    Documents meet by a digest of nested fields, types and values that decoding gives; a group of any size costs a row
    for each member, as all are named with its first (by path and place).
    """
    place = F.struct("path", "seq", "offset")
    first = docs.groupBy("digest").agg(F.min(F.struct("path", "seq", "offset", "id")).alias("first"), F.count("*").alias("n")).filter("n > 1")
    met = docs.join(first.withColumnRenamed("digest", "_digest"), F.col("digest") == F.col("_digest"))
    return met.filter(place > F.struct("first.path", "first.seq", "first.offset")).select("path", "collection", "id", F.col("first.path").alias("other_path"), F.col("first.id").alias("other_id"))
