"""Registered queries over backups of all kinds of records, made from the customers of each nation and decoded, with their SQL.

Archives of even nations are streams behind markers, those of odd nations have a file for each collection. What a customer's
record is goes by its number, so that SQL over the same table gives every result.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.operators import backup_tree, export
from lodestone.sources import backup
from lodestone.sources.store import dealt, folder, save_blobs, stored

QUERIES: dict = {}
ORACLES: dict = {}
#: Customers of one archive, at most.
PART = 10_000
_PATH = f"'n' || c_nationkey || '-' || (c_custkey // {PART})"
_SITE = "lpad(lower(to_hex(c_nationkey + 1)), 24, '0')"
#: Collection, the number by which its records' customers divide, and what is left: a customer is a client, and one record of each collection that it fits.
KINDS = {"device": (7, 1), "wlanconf": (5, 0), "networkconf": (11, 2), "firewallrule": (13, 3), "firewallgroup": (17, 4), "portforward": (19, 5), "routing": (23, 6), "portconf": (29, 7), "setting": (31, 8), "admin": (37, 9), "radiusprofile": (41, 10), "hotspotop": (43, 11), "account": (47, 12), "zone": (53, 13), "alarm": (59, 14)}


def query(sql: str):
    def add(f):
        QUERIES[f.__name__] = lambda spark, sf_dir: f(lambda name: spark.read.parquet(f"{sf_dir}/{name}.parquet"))
        QUERIES[f.__name__].__doc__ = f.__doc__
        ORACLES[f.__name__] = sql
        return f

    return add


def _backups(t, statistics: bool = False) -> DataFrame:
    import gzip
    import io
    import zipfile

    import pandas as pd

    from lodestone.sources import bson

    oid = lambda k: bson.Typed("objectId", f"{k:024x}")
    some = lambda **fields: {("_id" if k == "id" else k): v for k, v in fields.items() if v is not None}
    make = {
        "device": lambda k, n, s: some(id=oid(k), site_id=s, name=n if k % 2 else None, mac=f"m{k}", model=f"M{k % 4}", adopted=k % 3 == 0, port_overrides=[{"portconf_id": str(k), "n": 1}, {"portconf_id": "none"}]),
        "wlanconf": lambda k, n, s: some(id=str(k), site_id=s, name=n if k % 4 else None, x_passphrase=f"p{k}", vlan=k, enabled=k % 2 == 0, wlangroup_id=f"g{k % 3}"),
        "networkconf": lambda k, n, s: some(id=str(k), site_id=s, name=n, ip_subnet=f"10.{k % 256}.0.1/24" if k % 2 else None, vlan=2**40, is_nat=True),
        "firewallrule": lambda k, n, s: some(id=str(k), site_id=s, ruleset="LAN_IN", name=n, action="drop", rule_index=2000.5 + k, src_firewallgroup_ids=[str(k), str(k + 4)], enabled=True),
        "firewallgroup": lambda k, n, s: some(id=str(k), site_id=s, name=n, group_type="address-group", group_members=["10.0.0.1", k, None]),
        "portforward": lambda k, n, s: some(id=str(k), site_id=s, name=n, fwd=f"10.0.0.{k % 256}", dst_port=str(k), enabled=False),
        "routing": lambda k, n, s: some(id=str(k), site_id=s, name=n if k % 2 else None, enabled=True),
        "portconf": lambda k, n, s: some(id=str(k), site_id=s, name=n, forward="all", native_networkconf_id=str(k)),
        "setting": lambda k, n, s: some(id=str(k), site_id=s, key=f"key{k}"),
        "admin": lambda k, n, s: some(id=str(k), name=n, email=f"a{k}@b.c", x_shadow="s", time_created=bson.Typed("datetime", 1_700_000_000_000 + k)),
        "radiusprofile": lambda k, n, s: some(id=str(k), site_id=s, name=n),
        "hotspotop": lambda k, n, s: some(id=str(k), site_id=s, name=n, x_password=f"p{k}"),
        "account": lambda k, n, s: some(id=str(k), site_id=s, name=n, vlan=bson.Typed("int64", -(2**40))),
        "zone": lambda k, n, s: some(id=str(k), note=n, f=k / 4, big=bson.Typed("int64", 2**40 + k), when=bson.Typed("datetime", 0), re=bson.Typed("regex", ("a", "i")), at=bson.Typed("timestamp", (5, k)), raw=bson.Typed("binary", (4, bytes(16))), sub={"b": 1, "a": [k, None]}, yes=True) | {"no": None},
        "alarm": lambda k, n, s: {"note": f"n{k % 5}"},
    }

    def pack(part: pd.DataFrame) -> pd.DataFrame:
        nation, first = int(part["c_nationkey"].iloc[0]), int(part["c_custkey"].iloc[0])
        site = oid(nation + 1)
        rows = sorted((int(k), n) for k, n in zip(part["c_custkey"], part["c_name"], strict=True))
        found = {"site": [some(id=site, name=f"n{nation}", desc=f"Nation {nation}" if nation % 3 else None)], "wlangroup": [some(id="g0", site_id=site, name="G0"), some(id="g1", site_id=site)]}
        found |= {c: [make[c](k, n, site) for k, n in rows if k % d == r] for c, (d, r) in KINDS.items()}
        found["user"] = [some(id=str(k), site_id=site if k % 9 else "nowhere", hostname=f"h{k}", name=n if k % 2 else None, network_id=str(k), usergroup_id="") for k, n in rows]
        files = {"version": "9.5.21\r\n", "format": "8", "timestamp": "1713600000000"}
        if nation % 2:
            files |= {f"db/{c}.bson": b"".join(map(bson.encode, docs)) for c, docs in found.items() if docs}
        else:
            stream = b"".join(bson.encode({"collection": c}) + b"".join(map(bson.encode, docs)) for c, docs in sorted(found.items()) if docs)
            files |= {"db.gz": gzip.compress(stream)}
        if statistics:
            hours = b"".join(bson.encode({"_id": k, "n": k * 2}) for k, _ in rows if k % 3 == 0)
            files |= {"stat_hour.bson": hours} if nation % 2 else {"db_stat.gz": gzip.compress(bson.encode({"collection": "stat_hour"}) + hours)}
        out = io.BytesIO()
        with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
            for name, data in files.items():
                z.writestr(name, data)
        return pd.DataFrame({"path": [f"n{nation}-{first // PART}"], "content": [out.getvalue()]})

    rows = t("customer").select("c_nationkey", "c_custkey", "c_name").withColumn("part", F.expr(f"c_custkey div {PART}"))
    return dealt(rows, "c_nationkey", "part").groupBy("c_nationkey", "part").applyInPandas(pack, "path string, content binary")


def _scan(t) -> DataFrame:
    return backup.scanned(backup.archives(_backups(t)))


def _documents(t) -> DataFrame:
    return backup.documents(_scan(t))


def _of(collection: str) -> str:
    """The customers that have a record in a collection."""
    return f"(SELECT *, {_PATH} AS path, {_SITE} AS site FROM customer WHERE c_custkey % {KINDS[collection][0]} = {KINDS[collection][1]})"


_ARCHIVES = f"(SELECT DISTINCT {_PATH} AS path, c_nationkey, {_SITE} AS site FROM customer)"
_DOT = "' · '"
_OID = "lpad(lower(to_hex(c_custkey)), 24, '0')"
# collection: rank of its category, its place in it, kind, id prefix, category, title
_SITE_SQL = {
    "device": (0, 0, "device", "device", "devices", f"concat_ws({_DOT}, CASE WHEN c_custkey % 2 <> 0 THEN c_name END, 'm' || c_custkey, 'M' || c_custkey % 4)"),
    "networkconf": (2, 0, "network", "network", "networks", f"concat_ws({_DOT}, c_name, CASE WHEN c_custkey % 2 <> 0 THEN '10.' || c_custkey % 256 || '.0.1/24' END)"),
    "firewallrule": (3, 0, "firewallRule", "fwrule", "firewall", f"'LAN_IN' || {_DOT} || c_name"),
    "firewallgroup": (3, 1, "firewallGroup", "fwgroup", "firewall", f"'address-group' || {_DOT} || c_name"),
    "portforward": (3, 2, "portForward", "pf", "firewall", "c_name"),
    "routing": (3, 3, "routing", "rt", "firewall", "CASE WHEN c_custkey % 2 <> 0 THEN c_name ELSE '(unnamed route)' END"),
    "portconf": (4, 0, "portProfile", "pp", "portProfiles", "c_name"),
    "setting": (6, 0, "setting", "set", "settings", "'key' || c_custkey"),
}
_ALL_SQL = {"admin": (1, "admin", "admin", "admins", f"c_name || {_DOT} || 'a' || c_custkey || '@b.c'"), "radiusprofile": (2, "radius", "radius", "radius", "c_name"), "hotspotop": (3, "hotspotOp", "hsop", "hotspot", "c_name"), "account": (4, "account", "acct", "accounts", "c_name")}
_TITLES = {"sites": "Sites", "admins": "Admins", "radius": "RADIUS Profiles", "hotspot": "Hotspot Operators", "accounts": "Accounts", "opaque": "Other Collections"}
_CHILD_TITLES = {"devices": "Devices", "wlans": "WLANs", "networks": "Networks", "firewall": "Firewall", "portProfiles": "Port Profiles", "clients": "Clients", "settings": "Settings"}


def _tree() -> str:
    """Every node with the numbers that order it: category, category of the site, place in that, group, record."""
    client = f"concat_ws({_DOT}, CASE WHEN c_custkey % 2 <> 0 THEN c_name END, 'h' || c_custkey)"
    users = f"(SELECT *, {_PATH} AS path, {_SITE} AS site FROM customer WHERE c_custkey % 9 <> 0)"
    row = "SELECT path, {} AS a, {} AS b, {} AS c, {} AS d, {} AS e, {} AS depth, {} AS node_id, {} AS parent_id, '{}' AS kind, {} AS title FROM {}".format
    child = lambda category: f"'sitechild:' || site || ':{category}'"
    parts = [row(0, -1, -1, -1, -1, 1, "'site:' || site", "'cat:sites'", "site", "CASE WHEN c_nationkey % 3 <> 0 THEN 'Nation ' ELSE 'n' END || c_nationkey", _ARCHIVES)]
    for c, (b, at, kind, prefix, category, title) in _SITE_SQL.items():
        key = _OID if c == "device" else "c_custkey"
        shown = " WHERE EXISTS (SELECT 1 FROM customer o WHERE o.c_nationkey = x.c_nationkey AND o.c_custkey // 10000 = x.c_custkey // 10000 AND (o.c_custkey % 13 = 3 OR o.c_custkey % 17 = 4 OR o.c_custkey % 19 = 5))" if c == "routing" else ""
        parts.append(row(0, b, at, -1, "c_custkey", 3, f"'{prefix}:' || {key}", child(category), kind, title, _of(c) + " x" + shown))
    parts.append(row(0, 5, 0, -1, "c_custkey", 3, "'client:' || c_custkey", child("clients"), "client", client, users))
    parts.append(row(0, 1, 0, "g", -1, 3, "'wlangroup:g' || g", child("wlans"), "wlanGroup", "CASE g WHEN 0 THEN 'G0' ELSE 'Group' END", f"{_ARCHIVES}, (VALUES (0), (1)) v(g)"))
    own = "c_custkey % 3 < 2"
    parts.append(row(0, 1, f"CASE WHEN {own} THEN 0 ELSE 1 END", f"CASE WHEN {own} THEN c_custkey % 3 ELSE -1 END", "c_custkey", f"CASE WHEN {own} THEN 4 ELSE 3 END", "'wlan:' || c_custkey", f"CASE WHEN {own} THEN 'wlangroup:g' || c_custkey % 3 ELSE {child('wlans')} END", "wlan", "CASE WHEN c_custkey % 4 <> 0 THEN c_name ELSE '(unnamed)' END", _of("wlanconf")))
    inner = {"devices": (0, _of("device")), "wlans": (1, _ARCHIVES), "networks": (2, _of("networkconf")), "firewall": (3, f"(SELECT path, site FROM {_of('firewallrule')} UNION SELECT path, site FROM {_of('firewallgroup')} UNION SELECT path, site FROM {_of('portforward')})"), "portProfiles": (4, _of("portconf")), "clients": (5, users), "settings": (6, _of("setting"))}
    parts += [row(0, b, -1, -1, -1, 2, child(c), "'site:' || site", "siteChildCategory", f"'{_CHILD_TITLES[c]}'", f"(SELECT DISTINCT path, site FROM {rows})") for c, (b, rows) in inner.items()]
    tops = {"sites": (0, _ARCHIVES)}
    for c, (a, kind, prefix, category, title) in _ALL_SQL.items():
        parts.append(row(a, -1, -1, -1, "c_custkey", 1, f"'{prefix}:' || c_custkey", f"'cat:{category}'", kind, title, _of(c)))
        tops[category] = a, _of(c)
    for b, c in enumerate(("alarm", "zone")):
        own = "c_custkey" if c == "zone" else "''"
        parts.append(row(5, b, 0, -1, "c_custkey", 2, f"'oprec:{c}:' || {own}", f"'opcoll:{c}'", "opaqueRecord", "CAST(c_custkey AS VARCHAR)" if c == "zone" else "'(no id)'", _of(c)))
        parts.append(row(5, b, -1, -1, -1, 1, f"'opcoll:{c}'", "'cat:opaque'", "opaqueCollection", f"'{c}'", f"(SELECT DISTINCT path FROM {_of(c)})"))
    tops["opaque"] = 5, f"(SELECT path FROM {_of('zone')} UNION SELECT path FROM {_of('alarm')})"
    parts += [row(a, -2, -1, -1, -1, 0, f"'cat:{c}'", "CAST(NULL AS VARCHAR)", "category", f"'{_TITLES[c]}'", f"(SELECT DISTINCT path FROM {rows})") for c, (a, rows) in tops.items()]
    return " UNION ALL ".join(parts)


TREE = f"SELECT *, row_number() OVER (PARTITION BY path ORDER BY a, b, c, d, e) AS place FROM ({_tree()})"


def _placed(nodes: DataFrame) -> DataFrame:
    from pyspark.sql import Window

    return nodes.withColumn("place", F.row_number().over(Window.partitionBy("path").orderBy("key")).cast("long"))


@query(f"SELECT path, place, depth, node_id, parent_id, kind, title FROM ({TREE})")
def backup_flatten(t):
    """All nodes of all kinds, in the order of the outline."""
    return _placed(backup_tree.nodes(_documents(t))).select("path", "place", F.col("depth").cast("int").alias("depth"), "node_id", "parent_id", "kind", "title")


_SELECTION = "node_id = 'cat:admins' OR node_id LIKE 'sitechild:%:wlans' OR node_id = 'wlangroup:g0' OR node_id LIKE 'client:%7' OR node_id = 'opcoll:zone'"
_BELOW = "(kind = 'admin' OR node_id = 'cat:admins' OR kind IN ('wlan', 'wlanGroup') OR node_id LIKE 'sitechild:%:wlans' OR node_id LIKE 'client:%7' OR node_id = 'opcoll:zone' OR node_id LIKE 'oprec:zone:%')"


def _selected(nodes: DataFrame) -> DataFrame:
    return backup_tree.selected(nodes, nodes.filter(_SELECTION).select("path", "node_id"))


@query(f"SELECT path, node_id, kind FROM ({TREE}) WHERE {_BELOW}")
def backup_selection(t):
    """Selected nodes with all that is below them, once each although selections overlap."""
    return _selected(stored(backup_tree.nodes(_documents(t)), "tree")).select("path", "node_id", "kind")


@query(f"SELECT path, count(*) AS selected FROM ({TREE}) WHERE {_BELOW} AND kind NOT IN ('category', 'siteChildCategory', 'wlanGroup', 'opaqueCollection') GROUP BY 1")
def backup_selection_sections(t):
    """How many sections an export of the selection has."""
    nodes = stored(backup_tree.nodes(_documents(t)), "tree")
    return backup_tree.sections(_selected(nodes)).groupBy("path").agg(F.count("*").alias("selected"))


@query(f"SELECT {_PATH} AS path, 'stat_hour' AS collection, count(*) AS n, CAST(sum(2 * c_custkey) AS BIGINT) AS total FROM customer WHERE c_custkey % 3 = 0 GROUP BY 1")
def backup_statistics(t):
    """What statistics add to backups that have been scanned without them."""
    found = stored(backup.archives(_backups(t, True)), "archives")
    plain = stored(backup.scanned(found), "scan")
    docs = backup.documents(backup.with_statistics(found, plain)).join(backup.documents(plain).select("path", "collection").distinct(), ["path", "collection"], "left_anti")
    return docs.groupBy("path", "collection").agg(F.count("*").alias("n"), F.sum(backup.int64_value("n")).alias("total"))


@query(f"SELECT {_PATH} AS path, CASE WHEN c_nationkey % 2 = 0 THEN 'db.gz' ELSE 'db/user.bson' END AS entry, count(*) AS users FROM customer GROUP BY 1, 2")
def backup_files(t):
    """Encrypted archives written to files, opened from there and decrypted."""
    key, iv = b"0123456789abcdef", b"fedcba9876543210"
    blobs = _backups(t).withColumn("content", backup.encrypted("content", key, iv))
    spark = blobs.sparkSession
    at = f"{folder(spark)}/archives-{uuid.uuid4().hex}"
    save_blobs(blobs, at)
    found = backup.archives(backup.files(spark, f"{at}/*.bin"), key, iv).withColumn("path", F.regexp_extract("path", r"([^/]*)\.bin$", 1))
    docs = backup.documents(backup.scanned(found)).filter("collection = 'user'")
    return docs.groupBy("path", "entry").agg(F.count("*").alias("users"))


_SYMBOL = "CASE kind " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in backup_tree.SYMBOLS.items()) + " WHEN 'category' THEN CASE node_id " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in backup_tree.CATEGORY_SYMBOLS.items()) + " END ELSE CASE title " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in backup_tree.CHILD_SYMBOLS.items()) + " END END"


@query(f"SELECT kind, {_SYMBOL} AS symbol, count(*) AS n FROM ({TREE}) GROUP BY 1, 2")
def backup_symbols(t):
    """How many nodes each symbol stands for."""
    return backup_tree.nodes(_documents(t)).groupBy("kind", backup_tree.symbol().alias("symbol")).agg(F.count("*").alias("n"))


@query(f"SELECT path, place, node_id FROM ({TREE}) WHERE depth = 1 AND parent_id = 'cat:admins'")
def backup_scope(t):
    """What an outline shows of one category, in its order within the whole."""
    return backup_tree.scope(_placed(backup_tree.nodes(_documents(t))), "admins").select("path", "place", "node_id")


@query(f"SELECT path, node_id, parent_id, title FROM ({TREE}) WHERE parent_id IN ('wlangroup:g0', 'opcoll:zone') OR parent_id LIKE 'sitechild:%:firewall'")
def backup_children(t):
    """The children of groups, of an unknown collection and of a site's category."""
    nodes = stored(backup_tree.nodes(_documents(t)), "tree")
    return backup_tree.children(nodes, nodes.filter("node_id IN ('wlangroup:g0', 'opcoll:zone') OR node_id LIKE 'sitechild:%:firewall'")).select("path", "node_id", "parent_id", "title")


@query(f"SELECT path, node_id, kind, title FROM ({TREE}) WHERE node_id LIKE 'client:%3' OR node_id = 'cat:radius'")
def backup_lookup(t):
    """Nodes by their ids, the first of each in the outline."""
    nodes = stored(backup_tree.nodes(_documents(t)), "tree")
    wanted = nodes.filter("node_id LIKE 'client:%3' OR node_id = 'cat:radius'").select("path", "node_id")
    return backup_tree.lookup(nodes, wanted.unionByName(wanted)).select("path", "node_id", "kind", "title")


_COLLECTIONS = " UNION ALL ".join([f"SELECT path, '{c}' AS collection, count(*) AS n FROM {_of(c)} GROUP BY 1" for c in KINDS] + [f"SELECT path, 'site', 1 FROM {_ARCHIVES}", f"SELECT path, 'wlangroup', 2 FROM {_ARCHIVES}", f"SELECT {_PATH}, 'user', count(*) FROM customer GROUP BY 1"])


@query(f"SELECT path, collection, n, row_number() OVER (PARTITION BY path ORDER BY collection) AS place FROM ({_COLLECTIONS})")
def backup_collections(t):
    """The collections of each backup, in the order in which they are met."""
    return backup_tree.collections(_documents(t)).select("path", "collection", "n", F.col("place").cast("long").alias("place"))


@query(f"SELECT path, CAST({_OID} AS VARCHAR) AS id, '_id,site_id,' || CASE WHEN c_custkey % 2 <> 0 THEN 'name,' ELSE '' END || 'mac,model,adopted,port_overrides' AS names, CASE WHEN c_custkey % 2 <> 0 THEN 7 ELSE 6 END AS n, c_custkey % 2 <> 0 AS named, 2 AS items, '[' || '{{portconf_id, n}}, {{portconf_id}}' || ']' AS shown FROM {_of('device')}")
def backup_fields(t):
    """The fields of documents in their order: names, how many, whether one is there, and how an array is shown."""
    docs = _documents(t).filter("collection = 'device'")
    shown = F.element_at(F.filter("fields", lambda f: f["key"] == "port_overrides"), 1)["pretty"]
    return docs.select("path", "id", F.array_join(backup.field_names(), ",").alias("names"), F.size("fields").alias("n"), backup.has_field("name").alias("named"), backup.array_size("port_overrides").alias("items"), shown.alias("shown"))


_HIT = "kind = 'device' AND lower(title) LIKE '%· m3%'"


@query(f"SELECT path, node_id, {_HIT} AS hit FROM ({TREE}) x WHERE {_HIT} OR (node_id LIKE 'sitechild:%:devices' OR kind = 'site' OR node_id = 'cat:sites') AND EXISTS (SELECT 1 FROM ({TREE}) y WHERE y.path = x.path AND {_HIT})")
def backup_search(t):
    """Devices whose model is M3, with the nodes above them."""
    return backup_tree.found(stored(backup_tree.nodes(_documents(t)), "tree"), "· m3").select("path", "node_id", "hit")


def _ref(collection: str, rows: str, field: str, item: str, target: str, target_id: str, found: str, key: str = "CAST(c_custkey AS VARCHAR)") -> str:
    return f"SELECT path, '{collection}' AS collection, {key} AS id, '{field}' AS field, {item} AS item, '{target}' AS target, {target_id} AS target_id, {found} AS found FROM {rows}"


def _references_sql() -> str:
    users = f"(SELECT *, {_PATH} AS path, {_SITE} AS site FROM customer)"
    has = lambda c, k="c_custkey": f"(({k}) % {KINDS[c][0]} = {KINDS[c][1]})"
    text = "CAST(c_custkey AS VARCHAR)"
    parts = [_ref(c, _of(c), "site_id", "0", "site", "site", "true", _OID if c == "device" else text) for c in (*_SITE_SQL, "wlanconf", "radiusprofile", "hotspotop", "account")]
    parts.append(_ref("wlangroup", f"{_ARCHIVES}, (VALUES ('g0'), ('g1')) v(g)", "site_id", "0", "site", "site", "true", "g"))
    parts.append(_ref("user", users, "site_id", "0", "site", "CASE WHEN c_custkey % 9 <> 0 THEN site ELSE 'nowhere' END", "c_custkey % 9 <> 0"))
    parts.append(_ref("user", users, "network_id", "0", "networkconf", text, has("networkconf")))
    parts.append(_ref("wlanconf", _of("wlanconf"), "wlangroup_id", "0", "wlangroup", "'g' || c_custkey % 3", "c_custkey % 3 < 2"))
    parts.append(_ref("portconf", _of("portconf"), "native_networkconf_id", "0", "networkconf", text, has("networkconf")))
    parts.append(_ref("device", _of("device"), "port_overrides[].portconf_id", "0", "portconf", text, has("portconf"), _OID))
    parts.append(_ref("device", _of("device"), "port_overrides[].portconf_id", "1", "portconf", "'none'", "false", _OID))
    there = "EXISTS (SELECT 1 FROM {} g WHERE g.path = r.path AND g.c_custkey = r.c_custkey + {})".format
    parts += [_ref("firewallrule", _of("firewallrule") + " r", "src_firewallgroup_ids[]", str(i), "firewallgroup", f"CAST(c_custkey + {4 * i} AS VARCHAR)", there(_of("firewallgroup"), 4 * i)) for i in (0, 1)]
    return " UNION ALL ".join(parts)


@query(_references_sql())
def backup_references(t):
    """Every id that a document names in another collection, those of array items included, and whether it is there."""
    return backup_tree.references(stored(_documents(t), "documents"))


_LATER = "(SELECT *, row_number() OVER (PARTITION BY {} ORDER BY path{}) AS k FROM {}) WHERE k > 1".format


@query(f"SELECT path, 'site' AS collection, site AS id FROM {_LATER('site', '', _ARCHIVES)} UNION ALL SELECT path, 'wlangroup', g FROM {_LATER('site, g', '', _ARCHIVES + ", (VALUES ('g0'), ('g1')) v(g)")} UNION ALL SELECT path, 'alarm', '' FROM {_LATER('c_custkey % 5', ', c_custkey', _of('alarm'))}")
def backup_equal_documents(t):
    """Documents that are equal to an earlier one of any archive, field by field."""
    return backup_tree.equal_documents(stored(_documents(t), "documents")).select("path", "collection", "id")


@query(f"""SELECT path, CAST(c_custkey AS VARCHAR) AS id, 1099511627776 + c_custkey AS big, c_custkey / 4.0 AS f, c_custkey // 4 AS whole, 'document' AS kind, 'b,a' AS keys, 2 AS items, CAST(c_custkey AS BIGINT) AS first, true AS yes, 'null' AS nothing,
  '/a/i' AS re, 'Timestamp(5, ' || c_custkey || ')' AS at, '00000000-0000-0000-0000-000000000000' AS raw, '1970-01-01T00:00:00.000Z' AS moment, c_name || '!' AS changed FROM {_of("zone")}""")
def backup_values(t):
    """Values of every type, by name and by path."""
    docs = _documents(t).filter("collection = 'zone'")
    v = backup
    changed = F.element_at(F.filter(v.with_field("note", "string", F.concat(v.field_text("note"), F.lit("!"))), lambda f: f["key"] == "note"), 1)["display"]
    sub = F.element_at(F.filter("fields", lambda f: f["key"] == "sub"), 1)["display"]
    return docs.select(
        "path", "id", v.int64_value("big").alias("big"), v.double_value("f").alias("f"), v.int64_value("f").alias("whole"), v.field_type("sub").alias("kind"), F.regexp_replace(sub, "[{} ]", "").alias("keys"), F.size(v.variant_value("sub.a", "array<variant>")).alias("items"), v.variant_value("sub.a[0]", "long").alias("first"),
        v.field("yes", "bool").cast("boolean").alias("yes"), v.field("no", "null").alias("nothing"), v.field("re", "regex").alias("re"), v.field("at", "timestamp").alias("at"), v.field("raw", "binary").alias("raw"), v.field("when", "datetime").alias("moment"), changed.alias("changed"),
    )


@query(f"SELECT path, 'settingsOnly' AS kind, CAST(list_sort(['settingsOnlyDetected']) AS VARCHAR) AS codes FROM {_ARCHIVES} x WHERE EXISTS (SELECT 1 FROM {_of('admin')} a WHERE a.path = x.path) OR EXISTS (SELECT 1 FROM {_of('account')} a WHERE a.path = x.path) UNION ALL SELECT path, 'siteExport', '[siteExportDetected]' FROM {_ARCHIVES} x WHERE NOT EXISTS (SELECT 1 FROM {_of('admin')} a WHERE a.path = x.path) AND NOT EXISTS (SELECT 1 FROM {_of('account')} a WHERE a.path = x.path)")
def backup_kinds(t):
    """Which part of a controller each backup is, and what that is told by."""
    return backup.identity(_scan(t)).select("path", "kind", F.concat(F.lit("["), F.array_join(F.array_sort(F.transform("told", lambda x: x["code"])), ", "), F.lit("]")).alias("codes"))


# What exports of administrators, wireless networks and hotspot operators hold: name, value as text, value as JSON, condition, whether it is secret.
_N, _K = "c_name", "CAST(c_custkey AS VARCHAR)"
_SITE_FIELD = ("site_id", "site", "'{' || chr(10) || '    \"$oid\" : \"' || site || '\"' || chr(10) || '  }'", None, False)
_quoted = "'\"' || {} || '\"'".format
_FIELDS = {
    "admin": ("admin", f"{_N} || {_DOT} || 'a' || c_custkey || '@b.c'", [("_id", _K, _quoted(_K), None, False), ("name", _N, _quoted(_N), None, False), ("email", "'a' || c_custkey || '@b.c'", _quoted("'a' || c_custkey || '@b.c'"), None, False), ("x_shadow", "'s'", _quoted("'s'"), None, True), ("time_created", "strftime(make_timestamp_ms(1700000000000 + c_custkey), '%Y-%m-%dT%H:%M:%S.%gZ')", "'{' || chr(10) || '    \"$date\" : \"' || strftime(make_timestamp_ms(1700000000000 + c_custkey), '%Y-%m-%dT%H:%M:%S.%gZ') || '\"' || chr(10) || '  }'", None, False)]),
    "wlanconf": ("wlan", f"CASE WHEN c_custkey % 4 <> 0 THEN {_N} ELSE '(unnamed)' END", [("_id", _K, _quoted(_K), None, False), _SITE_FIELD, ("name", _N, _quoted(_N), "c_custkey % 4 <> 0", False), ("x_passphrase", "'p' || c_custkey", _quoted("'p' || c_custkey"), None, True), ("vlan", _K, _K, None, False), ("enabled", "CASE WHEN c_custkey % 2 = 0 THEN 'true' ELSE 'false' END", "CASE WHEN c_custkey % 2 = 0 THEN 'true' ELSE 'false' END", None, False), ("wlangroup_id", "'g' || c_custkey % 3", _quoted("'g' || c_custkey % 3"), None, False)]),
    "hotspotop": ("hotspot_operator", _N, [("_id", _K, _quoted(_K), None, False), _SITE_FIELD, ("name", _N, _quoted(_N), None, False), ("x_password", "'p' || c_custkey", _quoted("'p' || c_custkey"), None, True)]),
}
_NL = "chr(10)"
_KIND = f"CASE WHEN EXISTS (SELECT 1 FROM {_of('admin')} a WHERE a.path = x.path) OR EXISTS (SELECT 1 FROM {_of('account')} a WHERE a.path = x.path) THEN 'settingsOnly' ELSE 'siteExport' END"


def _when(condition: str | None, text: str) -> str:
    return f"CASE WHEN {condition} THEN {text} ELSE '' END" if condition else text


def _section_sql(kind: str, tag: str, title: str, fields: list, secrets: bool) -> str:
    shown = [(k, v if secrets or not hide else "'<redacted>'", j if secrets or not hide else _quoted("'<redacted>'"), c) for k, v, j, c, hide in fields]
    raw = "'{' || chr(10) || array_to_string([" + ", ".join((f"CASE WHEN {c} THEN " if c else "") + f"'  \"{k}\" : ' || {j}" + (" END" if c else "") for k, _, j, c in sorted(shown)) + "], ',' || chr(10)) || chr(10) || '}'"
    if kind == "text":
        lines = " || ".join(_when(c, f"'  {k}: ' || {v} || {_NL}") for k, v, _, c in shown)
        return f"'{export.RULE}' || {_NL} || '{tag.upper()}: ' || {title} || {_NL} || '{export.RULE}' || {_NL} || {lines} || {_NL}"
    if kind == "markdown":
        lines = " || ".join(_when(c, f"'| {k} | ' || {v} || ' |' || {_NL}") for k, v, _, c in shown)
        return f"'<{tag} title=\"' || {title} || '\">' || {_NL} || {_NL} || '| Key | Value |' || {_NL} || '|---|---|' || {_NL} || {lines} || {_NL} || '```json' || {_NL} || {raw} || {_NL} || '```' || {_NL} || {_NL} || '</{tag}>' || {_NL} || {_NL}"
    items = "array_to_string([" + ", ".join((f"CASE WHEN {c} THEN " if c else "") + f"'    {{' || {_NL} || '      \"key\" : \"{k}\",' || {_NL} || '      \"value\" : \"' || {v} || '\"' || {_NL} || '    }}'" + (" END" if c else "") for k, v, _, c in shown) + f"], ',' || {_NL})"
    body = f"'{{' || {_NL} || '  \"fields\" : [' || {_NL} || {items} || {_NL} || '  ],' || {_NL} || '  \"kind\" : \"{tag}\",' || {_NL} || '  \"raw\" : ' || replace({raw}, {_NL}, {_NL} || '  ') || ',' || {_NL} || '  \"title\" : \"' || {title} || '\"' || {_NL} || '}}'"
    return f"replace({body}, {_NL}, {_NL} || '    ')"


def _export_sql(kind: str, secrets: bool, head: list[str], foot: list[str], between: str = "''", before: str = "''") -> str:
    """(path, text) of each archive: lines of the head, sections in the order of the outline, lines of the foot; {n} is the number of sections."""
    order = {"wlanconf": "0", "admin": "1", "hotspotop": "3"}
    group = "CASE WHEN c_custkey % 3 < 2 THEN c_custkey % 3 ELSE 9 END"
    rows = " UNION ALL ".join(f"SELECT path, {order[c]} AS a, {group if c == 'wlanconf' else 0} AS b, c_custkey AS c, {before} || {_section_sql(kind, tag, title, fields, secrets)} AS s FROM {_of(c)}" for c, (tag, title, fields) in _FIELDS.items())
    lines = lambda some: " || ".join(some).replace("{n}", "coalesce(n, 0)").replace("{kind}", _KIND) or "''"
    return f"SELECT path, {lines(head)} || coalesce(body, '') || {lines(foot)} AS text FROM {_ARCHIVES} x LEFT JOIN (SELECT path, count(*) AS n, string_agg(s, {between} ORDER BY a, b, c) AS body FROM ({rows}) GROUP BY 1) USING (path)"


def _line(text: str, value: str = "''", end: str = "") -> str:
    return f"'{text}' || {value} || '{end}' || {_NL}"


_TEXT_SQL = _export_sql("text", True, [_line("BACKUP EXPORT"), _line("============="), _line("Controller version : 9.5.21"), _line("Backup format      : 8"), _line("Backup timestamp   : 2024-04-20T08:00:00Z"), _line("Backup kind        : ", "{kind}"), _line("Origin             : unknown"), _line("Selection count    : ", "{n}"), _line("Target model       : GPT (OpenAI)"), _line("Redacted           : false"), _line(""), _line("\u26a0  This export INCLUDES secrets (WPA keys, admin hashes, RADIUS,"), _line("   TOTP). Do not share."), _line("")], [])
_MARKDOWN_SQL = _export_sql("markdown", False, [_line("# Backup Export"), _line(""), _line("| Field | Value |"), _line("|---|---|"), _line("| Produced by | lodestone |"), _line("| Target model | Claude (Anthropic) |"), _line("| Controller version | 9.5.21 |"), _line("| Backup format | 8 |"), _line("| Backup timestamp | 2024-04-20T08:00:00Z |"), _line("| Backup kind | ", "{kind}", " |"), _line("| Origin | unknown |"), _line("| Selection count | ", "{n}", " |"), _line("| Redacted | true |"), _line("")], [])
_JSON_SQL = _export_sql("json", False, [_line("{"), _line('  "header" : {'), _line('    "format" : "8",'), _line('    "includesSecretsWarning" : false,'), _line('    "kind" : "', "{kind}", '",'), _line('    "origin" : "unknown",'), _line('    "producedBy" : "lodestone",'), _line('    "redacted" : true,'), _line('    "selectionCount" : ', "{n}", ","), _line('    "targetModel" : "gpt",'), _line('    "timestamp" : "2024-04-20T08:00:00Z",'), _line('    "version" : "9.5.21"'), _line("  },"), "'  \"sections\" : ['"], [f"CASE WHEN {{n}} > 0 THEN {_NL} ELSE {_NL} || {_NL} END", _line("  ]"), "'}'"], "','", f"{_NL} || '    '")


def _exported(t, kind: str, preset: str, secrets: bool) -> DataFrame:
    return _parts(stored(_scan(t), "scan"), kind, preset, secrets)


def _parts(scan: DataFrame, kind: str, preset: str, secrets: bool) -> DataFrame:
    nodes = stored(backup_tree.nodes(backup.documents(scan)), "tree").filter("kind IN ('admin', 'wlan', 'hotspotOp')")
    return export.whole(backup_tree.sections(nodes, secrets), backup.identity(scan), kind, preset, secrets)


@query(f"SELECT path, sha256(text) AS sha256, strlen(text) AS bytes FROM ({_TEXT_SQL})")
def backup_export_text(t):
    """Whole exports as text, with secrets."""
    return export.digests(_exported(t, "text", "gpt", True))


@query(f"SELECT path, sha256(text) AS sha256, strlen(text) AS bytes FROM ({_MARKDOWN_SQL})")
def backup_export_markdown(t):
    """Whole exports as Markdown with tags, secrets replaced."""
    return export.digests(_exported(t, "markdown", "claude", False))


@query(f"SELECT path, sha256(text) AS sha256, strlen(text) AS bytes FROM ({_JSON_SQL})")
def backup_export_json(t):
    """Whole exports as JSON, secrets replaced."""
    return export.digests(_exported(t, "json", "gpt", False))


@query(f"SELECT path, length_grapheme(text) AS n, length_grapheme(text) > 24000 AS over FROM ({_TEXT_SQL.replace('GPT (OpenAI)', 'Local (Llama / Mistral / Qwen)')})")
def backup_export_length(t):
    """What a reader counts of each export, its note left out, against a budget."""
    return export.lengths(_exported(t, "text", "local", True).filter(F.col("key") != export.FOOT), "local")


@query(f"SELECT path, substr(text, 1, 2000) AS text FROM ({_TEXT_SQL})")
def backup_export_preview(t):
    """The first 2,000 characters of each export."""
    return export.preview(_exported(t, "text", "gpt", True))


@query(f"SELECT path, 'Budget for Gemini (Google): ~800000 characters. Current: ' || length_grapheme(text) || ' characters.' AS hint FROM ({_TEXT_SQL.replace('GPT (OpenAI)', 'Gemini (Google)')})")
def backup_export_hint(t):
    """What each export takes of a budget."""
    return export.hint(_exported(t, "text", "gemini", True), "gemini")


@query(f"SELECT 'backup-2024-04-20-v9.5.21' || CASE WHEN k > 1 THEN '-' || k ELSE '' END || '.md' AS name, sha256, bytes FROM (SELECT path, row_number() OVER (ORDER BY path) AS k, sha256(text) AS sha256, strlen(text) AS bytes FROM ({_MARKDOWN_SQL}))")
def backup_export_files(t):
    """Exports written to files under their suggested names, and read back from there."""
    scan = stored(_scan(t), "scan")  # for the exports and their names
    parts = _parts(scan, "markdown", "claude", False)
    spark = parts.sparkSession
    at = f"{folder(spark)}/exports-{uuid.uuid4().hex}"
    names = export.suggested_name(backup.identity(scan), "markdown", day=F.lit("2024-04-20").cast("date"))
    export.save(parts, names, at)
    files = spark.read.format("binaryFile").load(at)
    return files.select(F.regexp_extract("path", "[^/]*$", 0).alias("name"), F.sha2("content", 256).alias("sha256"), F.col("length").alias("bytes"))


def _typed(name: str, /, **columns: str) -> None:
    """Registers the typed records of a collection, with the SQL of each column."""

    def run(t):
        """The typed records of a collection."""
        items = F.array_join("group_members", ",").alias("group_members") if "group_members" in columns else None
        return backup.typed(_documents(t), name).select("path", "id", *(items if c == "group_members" else c for c in columns))

    run.__name__ = f"backup_records_{name}"
    query(f"SELECT path, CAST({_OID if name == 'device' else 'c_custkey'} AS VARCHAR) AS id, {', '.join(f'{sql} AS {c}' for c, sql in columns.items())} FROM {_of(name)}")(run)


_typed("device", name="CASE WHEN c_custkey % 2 <> 0 THEN c_name END", mac="'m' || c_custkey", model="'M' || c_custkey % 4", adopted="c_custkey % 3 = 0", site_id="site")
_typed("networkconf", name="c_name", ip_subnet="CASE WHEN c_custkey % 2 <> 0 THEN '10.' || c_custkey % 256 || '.0.1/24' END", vlan="CAST(2147483647 AS INTEGER)", is_nat="true")
_typed("firewallrule", name="c_name", ruleset="'LAN_IN'", action="'drop'", rule_index="CAST(2000 + c_custkey AS INTEGER)", enabled="true")
_typed("firewallgroup", name="c_name", group_type="'address-group'", group_members="'10.0.0.1'")
_typed("portforward", name="c_name", fwd="'10.0.0.' || c_custkey % 256", dst_port="CAST(c_custkey AS VARCHAR)", enabled="false")
_typed("routing", name="CASE WHEN c_custkey % 2 <> 0 THEN c_name END", enabled="true")
_typed("portconf", name="c_name", forward="'all'", native_networkconf_id="CAST(c_custkey AS VARCHAR)")
_typed("setting", key="'key' || c_custkey")
_typed("radiusprofile", name="c_name")
_typed("hotspotop", name="c_name")
_typed("account", name="c_name", vlan="CAST(-2147483648 AS INTEGER)")
