"""Backups: encrypted or plain archives of document streams, read file by file in parallel.

files -> archives -> one scan of each -> entries, documents and what is wrong, all of them rows. A scan inflates and
decodes chunk by chunk: a task holds an archive's packed bytes, a chunk, and BATCH documents. What is wrong with a file, an entry
or a document is a row of diagnostics and never fails the job. Decryption, layout, collections, identity and
typed records are Spark expressions; tasks run Python only to inflate and to decode.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.functions.text import REDACTED, epoch_or_iso, first_rule, sanitise
from lodestone.operators.ordered import UNCATEGORIZED, pick_first
from lodestone.operators.redact import SECRET_FIELDS
from lodestone.sources import bson
from lodestone.sources.archive import ZIP, Member, gunzipped, members

FIELDS = "array<struct<pos:int,key:string,type:string,display:string,pretty:string,secret:boolean>>"
#: What a scan gives: a row for each entry, document and problem.
SCAN = f"path string, kind string, entry string, seq int, collection string, offset long, id string, fields {FIELDS}, body string, body_redacted string, secrets array<string>, digest string, bytes long, data binary, severity string, code string, message string"
DOCUMENTS = ("path", "entry", "seq", "collection", "offset", "id", "fields", "body", "body_redacted", "secrets", "digest")
#: Rows that a task hands over at once.
BATCH = 500
#: Collections that only a load of statistics reads.
STATISTICS = ("stat_", "event_archive", "rogue")
#: Entries whose content a scan keeps, to tell a backup's identity.
IDENTITY = ("version", "format", "timestamp", "system.properties")
#: Documents before the first marker whose keys are told, and how many keys.
SAMPLES, KEYS = 2, 8


def files(spark: SparkSession, pattern: str) -> DataFrame:
    return spark.read.format("binaryFile").load(pattern).select("path", "content")


def is_zip(content: Column) -> Column:
    return F.coalesce(F.substring(content, 1, 4) == F.lit(ZIP), F.lit(False))


def decrypted(content: str, key: bytes, iv: bytes) -> Column:
    """AES-128-CBC without padding, by the built-in decryption: a block that decrypts to padding is put after the content.

    Null if the length is no positive multiple of 16.
    """
    k, v = f"X'{key.hex()}'", f"X'{iv.hex()}'"
    pad = f"substring(aes_encrypt(X'', {k}, 'CBC', 'PKCS', substring({content}, -16, 16)), 17, 16)"
    return F.expr(f"CASE WHEN length({content}) > 0 AND length({content}) % 16 = 0 THEN try_aes_decrypt(concat({v}, {content}, {pad}), {k}, 'CBC', 'PKCS') END")


def encrypted(content: str, key: bytes, iv: bytes) -> Column:
    """What decrypted() undoes: content, filled up with zeros to whole blocks, without padding."""
    k, v = f"X'{key.hex()}'", f"X'{iv.hex()}'"
    whole = f"concat({content}, substring(X'{'00' * 15}', 1, CAST(pmod(-length({content}), 16) AS INT)))"
    return F.expr(f"substring(aes_encrypt({whole}, {k}, 'CBC', 'PKCS', {v}), 17, length({whole}))")


def archives(blobs: DataFrame, key: bytes | None = None, iv: bytes | None = None) -> DataFrame:
    """(path, content, status): archives in the clear; status is ok, notZip or truncatedAtBlockBoundary."""
    plain = F.when(is_zip(F.col("content")), F.col("content"))
    if key is not None:
        plain = plain.otherwise(decrypted("content", key, iv))
    rows = blobs.withColumn("plain", plain)
    status = F.when(is_zip(F.col("plain")), "ok").when(F.lit(key is not None) & (F.length("content") % 16 != 0), "truncatedAtBlockBoundary").otherwise("notZip")
    return rows.select("path", F.when(is_zip(F.col("plain")), F.col("plain")).alias("content"), status.alias("status"))


def _last(data: memoryview) -> dict[str, Member]:
    """The entries that can be read by name; of repeated names the last."""
    return {m.name: m for m in members(data) if m.problem is None}


def embedded(blobs: DataFrame, key: bytes | None = None, iv: bytes | None = None) -> DataFrame:
    """(path, content) of the backup inside each container of blobs, which are archives in the clear.

    First a name that ends .unf, the smallest; then one with "network" of whole cipher blocks, the smallest; then, by
    size from the largest, what decrypts to an archive. Containers without any give no row. Entries that can't be one aren't unpacked.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for path, content in zip(batch["path"], batch["content"], strict=True):
                data = memoryview(bytes(content))
                for name, m in _last(data).items():
                    if name.lower().endswith(".unf") or m.size >= 16 and m.size % 16 == 0:
                        yield pd.DataFrame({"path": [path], "name": [name], "data": [b"".join(m.chunks(data))]})

    found = blobs.filter(is_zip(F.col("content"))).select("path", "content").mapInPandas(run, "path string, name string, data binary")
    size, name = F.length("data"), F.lower("name")
    whole = (size % 16 == 0) & ~is_zip(F.col("data"))
    tier = F.when(name.endswith(".unf"), 1).when(name.contains("network") & (size >= 16) & whole, 2)
    if key is not None:
        tier = tier.when((size >= 64) & whole & is_zip(decrypted("data", key, iv)), 3)
    inner = found.withColumn("tier", tier).filter("tier IS NOT NULL")
    best = pick_first(inner, ["path"], [F.col("tier"), F.when(F.col("tier") < 3, F.col("name")), F.desc(size), F.col("name")])
    return best.select("path", F.col("data").alias("content"))


def opened(blobs: DataFrame, key: bytes | None = None, iv: bytes | None = None) -> DataFrame:
    """(path, content, status) of blobs (path, content): as archives(), but of a container the backup inside it, if that can be read, before its own payload."""
    inner = archives(embedded(blobs, key, iv), key, iv).filter("status = 'ok'")
    return archives(blobs, key, iv).join(inner.select("path"), "path", "left_anti").unionByName(inner)


def _marker(fields: list) -> str | None:
    """The collection that a small document announces."""
    if not 1 <= len(fields) <= 4:
        return None
    text = {k: v for k, kind, v in fields if kind == "string" and v}
    for key in ("collection", "ns", "namespace"):
        if key in text:
            return text[key] if key == "collection" else text[key].partition(".")[2] or text[key]
    return None


def _base(name: str) -> str:
    """An entry's name without folders and its last extension."""
    name = name.rpartition("/")[2]
    return name.rpartition(".")[0] if "." in name[1:] else name


def _document(fields: list, secrets: frozenset[str]) -> dict:
    ids = [(t, v) for k, t, v in fields if k == "_id"][-1:]
    own = bson.display(*ids[0]) if ids and ids[0][0] in ("objectId", "string", "int32", "int64") else ""
    shown = []
    for i, (k, t, v) in enumerate(fields):
        text = bson.display(t, v)
        shown.append({"pos": i, "key": k, "type": t, "display": text, "pretty": REDACTED if k in secrets else bson.pretty(t, v) if t == "array" else text, "secret": k in secrets})
    paths = bson.named_paths(fields, secrets)
    body = bson.as_json(fields)
    return {"id": own, "fields": shown, "body": body, "body_redacted": bson.as_json(bson.redacted(fields, secrets, REDACTED)) if paths else body, "secrets": paths, "digest": bson.fingerprint(fields)}


def _scan(content: bytes, statistics: bool, secrets: frozenset[str], configuration: bool = True) -> Iterator[dict]:
    """The rows of SCAN of one archive; without configuration those of statistics alone."""
    data, last, problems = memoryview(content), {}, []
    for m in members(data):
        if m.problem:
            problems.append(m)
        else:
            last[m.name] = m
    problem = lambda severity, code, message, **more: {"kind": "problem", "severity": severity, "code": code, "message": message} | more
    names = sorted(last)
    by_file = [n for n in names if n.endswith(".bson") and not n.startswith("__MACOSX")]
    if configuration:
        if problems and last:
            yield problem("info", "zipRecoveryMode", f"read by its local headers, with {len(problems)} warnings")
        yield from (problem("warning", "zipEntryUnreadable", m.problem, offset=m.at) for m in problems)
        if not last:
            yield problem("error", "zipUnreadable", "no entry can be read")
        for seq, name in enumerate(names):
            kept = b"".join(last[name].chunks(data)) if name in IDENTITY else None
            yield {"kind": "entry", "entry": name, "seq": seq, "bytes": last[name].size, "data": kept}
        if last and not by_file and "db.gz" not in last:
            yield problem("error", "configurationDatabaseMissing", "neither .bson entries nor db.gz")
    of_statistics = lambda n: _base(n).startswith(STATISTICS) if by_file else n == "db_stat.gz"
    wanted = [n for n in by_file or ("db.gz", "db_stat.gz") if n in last and (statistics if of_statistics(n) else configuration)]
    bases: dict[str, str] = {}
    for name in wanted:
        told: list[str] = []
        base = _base(name) if by_file else None
        if base in bases:
            yield problem("warning", "other", f"{name} has the collection of {bases[base]}, too", entry=name, collection=base)
        bases.setdefault(base or "", name)
        collection, orphans, n = base or UNCATEGORIZED, 0, 0
        here = {"entry": name, "seq": names.index(name)}
        for offset, fields, error in bson.stream(gunzipped(last[name].chunks(data), told)):
            at = here | {"offset": offset, "collection": collection}
            if error:
                severity = "warning" if by_file or error == "nested too deep" else "error"
                if not (told and error == "unexpected end"):  # a gzip stream that is cut tells that itself
                    yield problem(severity, "bsonMalformedDocument", f"{name}: {error}", **at)
                continue
            if not by_file:
                marker = _marker(fields)
                if marker is not None:
                    collection = marker
                    continue
                if collection == UNCATEGORIZED:
                    if orphans == 0:
                        yield problem("warning", "orphanedRecord", f"documents before the first marker of {name}", **at)
                    if orphans < SAMPLES:
                        yield problem("info", "other", f"keys of a document before the first marker: {','.join([k for k, _, _ in fields][:KEYS])}{',…' if len(fields) > KEYS else ''}", **at)
                    orphans += 1
            n += 1
            yield at | _document(fields, secrets) | {"kind": "document"}
        for message in told:
            code = "truncatedStatsStream" if name == "db_stat.gz" else "configurationDatabaseMissing" if name == "db.gz" and not n else "zipEntryUnreadable"
            yield problem("error" if code == "configurationDatabaseMissing" else "warning", code, f"{name}: {message}, after {n} documents", **here)


def scanned(found: DataFrame, statistics: bool = False, secrets: frozenset[str] = frozenset(SECRET_FIELDS), configuration: bool = True) -> DataFrame:
    """Rows of SCAN of archives (path, content): their entries, documents and problems, in one pass.

    An archive with .bson entries is read by its files, and their names are the collections; else db.gz
    is one stream in which markers name the collection of what follows, and db_stat.gz another, if
    statistics are asked for. What follows an error in a stream isn't read, but for a document that is too deep,
    which is left out alone. seq is an entry's place by name; (seq, offset) is a document's place in its archive.
    """
    columns = [x.split()[0] for x in SCAN.replace(FIELDS, "f").split(", ")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for path, content in zip(batch["path"], batch["content"], strict=True):
                rows = []
                for row in _scan(bytes(content), statistics, secrets, configuration):
                    rows.append([path if c == "path" else row.get(c) for c in columns])
                    if len(rows) == BATCH:
                        yield pd.DataFrame(rows, columns=columns, dtype=object)
                        rows = []
                yield pd.DataFrame(rows, columns=columns, dtype=object)

    return found.filter("content IS NOT NULL").select("path", "content").mapInPandas(run, SCAN)


def with_statistics(found: DataFrame, scan: DataFrame, secrets: frozenset[str] = frozenset(SECRET_FIELDS)) -> DataFrame:
    """A scan without statistics and what those of the same archives add: nothing else is decoded again."""
    return scan.unionByName(scanned(found, True, secrets, configuration=False))


def documents(scan: DataFrame) -> DataFrame:
    """The documents of a scan, with the columns of DOCUMENTS."""
    return scan.filter("kind = 'document'").select(*DOCUMENTS)


def inventory(scan: DataFrame) -> DataFrame:
    """(path, name, bytes) of the entries that can be read."""
    return scan.filter("kind = 'entry'").select("path", F.col("entry").alias("name"), "bytes")


#: Severity of each code that diagnostics() gives.
SEVERITIES = {"info": 0, "warning": 1, "error": 2}


def diagnostics(found: DataFrame, scan: DataFrame) -> DataFrame:
    """(path, severity, code, message, position, collection) of all that went wrong in archives (path, status) and their scan.

    Documents before the first marker are orphans, told once for a stream, with the keys of the first SAMPLES of them;
    collections without a typed record are summed up; identity() tells what it can't read and which kind a backup is.
    """
    none = F.lit(None)

    def row(rows: DataFrame, severity: Column, code: Column, message: Column, position: Column = none, collection: Column = none) -> DataFrame:
        return rows.select("path", severity.alias("severity"), code.alias("code"), message.alias("message"), position.cast("long").alias("position"), collection.cast("string").alias("collection"))

    told = identity(scan).select("path", F.explode("told").alias("t"))
    parts = [
        row(found.filter("status <> 'ok'"), F.lit("error"), F.col("status"), F.lit("not readable as a backup")),
        row(scan.filter("kind = 'problem'"), F.col("severity"), F.col("code"), F.col("message"), F.col("offset"), F.col("collection")),
        row(told, F.col("t.severity"), F.col("t.code"), F.col("t.message")),
        row(opaque_summary(documents(scan)), F.lit("info"), F.lit("unknownCollection"), F.col("summary")),
    ]
    return reduce(DataFrame.unionByName, parts)


def severity_badge(told: DataFrame) -> DataFrame:
    """(path, infos, problems, worst) of diagnostics: worst is the rank of the highest severity."""
    rank = F.element_at(F.create_map(*[F.lit(x) for pair in SEVERITIES.items() for x in pair]), F.col("severity"))
    return told.groupBy("path").agg(F.count_if(F.col("severity") == "info").alias("infos"), F.count_if(F.col("severity") != "info").alias("problems"), F.max(rank).alias("worst"))


def report(told: DataFrame, infos: bool = False) -> DataFrame:
    """(path, line) of diagnostics as bullets; without infos unless they are asked for."""
    parts = [F.lit("- ["), F.col("severity"), F.lit("] `"), F.col("code"), F.lit("` "), F.col("message")]
    extra = [F.coalesce(F.concat(F.lit(" (collection "), F.col("collection"), F.lit(")")), F.lit("")), F.coalesce(F.concat(F.lit(" at offset "), F.col("position").cast("string")), F.lit(""))]
    return told.filter(F.lit(infos) | (F.col("severity") != "info")).select("path", F.concat(*parts, *extra).alias("line"))


def secret_counts(docs: DataFrame) -> DataFrame:
    """(path, collection, secret, n): how often each secret path stands in the documents."""
    return docs.select("path", "collection", F.explode("secrets").alias("secret")).groupBy("path", "collection", "secret").agg(F.count("*").alias("n"))


def identity(scan: DataFrame, origins: Sequence[tuple[str, str]] = ()) -> DataFrame:
    """(path, version, format, timestamp, kind, origin, told) of each archive of a scan, in one grouping.

    origins are (substring, origin) rules for the properties entry, first match wins. Text that isn't UTF-8, and a
    timestamp that is neither a number of milliseconds nor ISO 8601, counts as missing; told (severity, code, message) says so, and which kind
    of part a backup is.
    """
    raw = F.col("data").cast("string")
    entry = lambda name: (F.col("kind") == "entry") & (F.col("entry") == name)
    of = lambda name: F.max(F.when(entry(name) & F.is_valid_utf8(raw), raw))
    bad = lambda name: F.coalesce(F.bool_or(entry(name) & ~F.is_valid_utf8(raw)), F.lit(False)).alias(f"bad_{name}")
    has = lambda c: F.coalesce(F.bool_or((F.col("kind") == "document") & (F.col("collection") == c)), F.lit(False)).alias(c)
    stats = F.coalesce(F.bool_or((F.col("kind") == "entry") & F.col("entry").endswith("db_stat.gz")), F.lit(False))
    named = [of(n).alias(n.rpartition(".")[2]) for n in IDENTITY]
    rows = scan.groupBy("path").agg(*named, *[bad(n) for n in IDENTITY[:3]], *[has(c) for c in ("site", "admin", "account")], stats.alias("stats"))
    clean = lambda c: F.nullif(sanitise(F.col(c)), F.lit(""))
    rows = rows.withColumns({"version": clean("version"), "format": clean("format"), "stamp": sanitise(F.col("timestamp"))}).withColumn("timestamp", epoch_or_iso(F.col("stamp")))
    kind = F.when(F.expr("site AND NOT admin AND NOT account"), "siteExport").when(F.expr("site AND NOT stats"), "settingsOnly").when(F.col("site"), "full").otherwise("unknown")
    rows = rows.withColumn("kind", kind)
    note = lambda when, severity, code, message: F.when(when, F.struct(F.lit(severity).alias("severity"), F.lit(code).alias("code"), message.alias("message")))
    told = [note(F.col(f"bad_{n}"), "warning", f"{n}Unparseable", F.lit(f"{n} is no UTF-8")) for n in IDENTITY[:3]]
    told.append(note(F.col("stamp").isNotNull() & F.col("timestamp").isNull(), "warning", "timestampUnparseable", F.concat(F.lit("timestamp is neither milliseconds nor ISO 8601: "), "stamp")))
    told.append(note(F.col("kind") == "siteExport", "info", "siteExportDetected", F.lit("one site, without the collections of the whole")))
    told.append(note(F.col("kind") == "settingsOnly", "info", "settingsOnlyDetected", F.lit("no statistics")))
    origin = first_rule(F.coalesce("properties", F.lit("")), origins, "unknown")
    return rows.select("path", "version", "format", "timestamp", "kind", origin.alias("origin"), F.array_compact(F.array(*told)).alias("told"))


def field(name: str, *types: str) -> Column:
    """The last field of a name, if it is of one of the types; strict, as the typed records are."""
    own = F.filter("fields", lambda f: f["key"] == name)
    last = F.try_element_at(own, F.lit(-1))
    return F.when(last["type"].isin(*types), last["display"])


def field_text(name: str) -> Column:
    """The last field of a name, if it is a string."""
    return field(name, "string")


def field_names() -> Column:
    """The names of a document's fields, in their order."""
    return F.transform("fields", lambda f: f["key"])


def has_field(name: str) -> Column:
    return F.exists("fields", lambda f: f["key"] == name)


def field_type(name: str) -> Column:
    """The type of the last field of a name; null if there is none."""
    return F.try_element_at(F.filter("fields", lambda f: f["key"] == name), F.lit(-1))["type"]


def int64_value(name: str) -> Column:
    """A number as a 64-bit integer: doubles cut, those outside null."""
    return F.coalesce(field(name, "int32", "int64").try_cast("long"), field(name, "double").try_cast("double").try_cast("long"))


def double_value(name: str) -> Column:
    return field(name, "double", "int32", "int64").try_cast("double")


def variant_value(path: str, kind: str = "variant") -> Column:
    """What stands at a path of a document, as a variant or a type; null if it isn't there or is no such value."""
    return F.try_variant_get(F.try_parse_json("body"), f"$.{path}", kind)


def document_keys(name: str) -> Column:
    """The names of a nested document's fields in their order of JSON; null if the field is none."""
    return F.when(field_type(name) == "document", F.json_object_keys(F.to_json(variant_value(name))))


def array_size(name: str) -> Column:
    return F.when(field_type(name) == "array", F.size(variant_value(name, "array<variant>")))


def with_field(name: str, kind: str, display: Column) -> Column:
    """The fields with the last one of a name replaced, one added at the end if there is none, or the last one taken out if display is null."""
    at = F.array_max(F.transform(F.filter("fields", lambda f: f["key"] == name), lambda f: f["pos"]))
    new = lambda pos: F.struct(pos.cast("int").alias("pos"), F.lit(name).alias("key"), F.lit(kind).alias("type"), display.alias("display"), display.alias("pretty"), F.lit(name in SECRET_FIELDS).alias("secret"))
    changed = F.transform("fields", lambda f: F.when(f["pos"] == at, new(f["pos"])).otherwise(f))
    more = F.concat("fields", F.array(new(F.size("fields"))))
    gone = F.coalesce(F.filter("fields", lambda f: f["pos"] != at), F.col("fields"))
    return F.when(display.isNull(), F.when(at.isNull(), F.col("fields")).otherwise(gone)).when(at.isNull(), more).otherwise(changed)


def _whole(name: str) -> Column:
    """A field as a 32-bit integer: wide integers at the nearest bound, doubles cut; what lies outside is null."""
    wide = field(name, "int32", "int64").try_cast("long")
    near = F.when(wide.isNotNull(), F.least(F.greatest(wide, F.lit(-(1 << 31))), F.lit((1 << 31) - 1)))  # bounds alone would stand for null
    return F.coalesce(near.cast("int"), field(name, "double").try_cast("double").try_cast("int"))


def _strings(name: str) -> Column:
    """The strings among an array's elements; no array: none."""
    items = F.expr(f"try_variant_get(try_parse_json(body), '$.{name}', 'array<variant>')")
    return F.coalesce(F.transform(F.filter(items, lambda x: F.schema_of_variant(x) == "STRING"), lambda x: x.cast("string")), F.array().cast("array<string>"))


def _time(name: str) -> Column:
    """A date-time, or a 64-bit integer in the range that milliseconds of our time have."""
    number = field(name, "int64").try_cast("long")
    return F.coalesce(field(name, "datetime").try_cast("timestamp"), F.when((number > 10**12) & (number < 10**13), F.timestamp_millis(number)))


_TYPES = {
    "string": lambda name: field(name, "string"),
    "id": lambda name: field(name, "objectId", "string"),
    "text": lambda name: F.coalesce(field(name, "string"), F.lit("")),
    "bool": lambda name: field(name, "bool").try_cast("boolean"),
    "int": _whole,
    "time": _time,
    "strings": _strings,
}


def _spec(text: str = "", /, site: bool = True, **kinds: str) -> list[tuple[str, tuple[str, ...], str]]:
    """Columns that are named as their fields: strings, then those of other kinds."""
    named = {"site_id": "id"} if site else {}
    named |= dict.fromkeys(text.split(), "string") | {n: kind for kind, names in kinds.items() for n in names.split()}
    return [(n, (n,), kind) for n, kind in named.items()]


#: Collections that have a typed record: column, field names in order of preference, type. Field names are fixed values of the format.
SPECS: dict[str, list[tuple[str, tuple[str, ...], str]]] = {
    "site": [*_spec("desc attr_hidden_id", site=False, text="name", bool="attr_no_delete"), ("title", ("desc", "name"), "string")],
    "device": _spec("mac name model type version serial", bool="adopted"),
    "user": [*_spec("mac hostname name fixed_ip", bool="is_guest is_wired noted", id="usergroup_id network_id"), ("title", ("name", "hostname"), "string")],
    "wlanconf": _spec("name security wpa_mode x_passphrase", int="vlan", bool="enabled is_guest", id="wlangroup_id usergroup_id"),
    "wlangroup": _spec("name"),
    "networkconf": _spec("name purpose ip_subnet domain_name", int="vlan", bool="is_nat"),
    "portconf": _spec("name forward poe_mode", id="native_networkconf_id"),
    "portforward": _spec("name fwd src proto dst_port fwd_port", bool="enabled"),
    "firewallrule": _spec("name ruleset action protocol", int="rule_index", bool="enabled"),
    "firewallgroup": _spec("name group_type", strings="group_members"),
    "routing": _spec("name", bool="enabled"),
    "admin": _spec("name email last_site_name", site=False, time="time_created"),
    "account": _spec("name tunnel_type", int="vlan"),
    "radiusprofile": _spec("name"),
    "hotspotop": _spec("name"),
    "setting": _spec("key"),
}


def register_collection(name: str, spec: list[tuple[str, tuple[str, ...], str]]) -> None:
    SPECS[name] = spec


def typed(docs: DataFrame, collection: str) -> DataFrame:
    """The records of a collection by its spec, with their raw body."""
    columns = [F.coalesce(*[_TYPES[kind](f) for f in names]).alias(c) for c, names, kind in SPECS[collection]]
    return docs.filter((F.col("collection") == collection)).select("path", "id", *columns, "body", "body_redacted", "fields", "entry", "seq", "offset")


def opaque(docs: DataFrame) -> DataFrame:
    """(path, collection, n, first_seen) of the collections without a typed record."""
    return docs.filter(~F.col("collection").isin(*SPECS)).groupBy("path", "collection").agg(F.count("*").alias("n"), F.min(F.struct("seq", "offset")).alias("first_seen"))


def opaque_records(docs: DataFrame) -> DataFrame:
    """(path, collection, id, body) of the records of collections without a typed record."""
    return docs.filter(~F.col("collection").isin(*SPECS)).select("path", "collection", "id", "body")


def opaque_summary(docs: DataFrame) -> DataFrame:
    """(path, summary): name(count) of those collections, in the order in which they are met."""
    listed = F.sort_array(F.collect_list(F.struct("first_seen", F.concat("collection", F.lit("("), F.col("n").cast("string"), F.lit(")")).alias("s"))))  # a row for each collection
    return opaque(docs).groupBy("path").agg(F.array_join(F.transform(listed, lambda x: x["s"]), ", ").alias("summary"))


def overview(docs: DataFrame) -> DataFrame:
    """A row for each path: how many records of the main collections it has, and how many secrets in all."""
    named = {"sites": "site", "devices": "device", "wlans": "wlanconf", "networks": "networkconf", "rules": "firewallrule", "admins": "admin"}
    return docs.groupBy("path").agg(*[F.count_if(F.col("collection") == c).alias(k) for k, c in named.items()], F.sum(F.size("secrets").cast("long")).alias("secrets"))
