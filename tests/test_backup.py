import gzip
import io
import json
import zipfile

import pytest
from pyspark.sql import functions as F

from lodestone.operators import backup_tree, export, tree
from lodestone.plans import archives, star
from lodestone.sources import backup, bson


def archive(files, **kw):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for name, data in files.items():
            z.writestr(name, data)
    return out.getvalue()


def test_round_trip_of_documents():
    doc = {"a": 1, "b": "x", "c": None, "d": [1, True], "e": {"f": 2.5}, "g": 2**40}
    fields, end = bson.document(bson.encode(doc))
    assert bson.plain("document", fields) == doc and end == len(bson.encode(doc))


def test_stream_markers_and_cut_off(spark):
    stream = bson.encode({"k": 1}) + bson.encode({"collection": "site"}) + bson.encode({"_id": "s", "name": "n", "desc": "d"}) + bson.encode({"ns": "ace.user"}) + bson.encode({"_id": "u", "hostname": "h"}) + b"\x05\0\0\0\1" + bson.encode({"_id": "lost"})
    blobs = spark.createDataFrame([("p", archive({"db.gz": gzip.compress(stream)})), ("bad", b"12345")], "path string, content binary")
    found = backup.archives(blobs)
    scan = backup.scanned(found).cache()
    docs = backup.documents(scan)
    assert {(r.collection, r.id) for r in docs.collect()} == {("_uncategorized", ""), ("site", "s"), ("user", "u")}
    assert [r.title for r in backup.typed(docs, "site").collect()] == ["d"]
    assert [(r.name, r.title) for r in backup.typed(docs, "user").collect()] == [(None, "h")]
    told = {(r.code, r.severity, r.collection) for r in backup.diagnostics(found, scan).collect()}
    assert told == {("notZip", "error", None), ("bsonMalformedDocument", "error", "user"), ("orphanedRecord", "warning", "_uncategorized"), ("other", "info", "_uncategorized"), ("unknownCollection", "info", None), ("siteExportDetected", "info", None)}


def test_files_win_and_statistics_are_pruned(spark):
    files = {"db.gz": gzip.compress(bson.encode({"k": 1})), "x/site.bson": bson.encode({"_id": "a"}), "stat_hour.bson": bson.encode({"_id": "b"})}
    found = backup.archives(spark.createDataFrame([("p", archive(files))], "path string, content binary"))
    assert [r.collection for r in backup.documents(backup.scanned(found)).collect()] == ["site"]
    assert {r.collection for r in backup.documents(backup.scanned(found, True)).collect()} == {"site", "stat_hour"}


def test_decryption_without_padding(spark):
    key, iv = b"0123456789abcdef", b"fedcba9876543210"
    plain = archive({"version": "1"})
    plain += b"\0" * (-len(plain) % 16)
    row = spark.createDataFrame([("p", plain)], "path string, content binary").selectExpr("path", f"substring(aes_encrypt(content, X'{key.hex()}', 'CBC', 'PKCS', X'{iv.hex()}'), 17, length(content)) AS content")
    assert bytes(backup.archives(row, key, iv).first().content) == plain
    assert backup.archives(row.selectExpr("path", "substring(content, 1, 15) AS content"), key, iv).first().status == "truncatedAtBlockBoundary"


def test_typed_records_are_strict(spark):
    docs = {
        "firewallgroup": {"_id": "g", "site_id": "s", "name": "n", "group_members": ["a", 1, None, "b"]},
        "wlanconf": {"_id": "w", "site_id": "s", "name": 5, "vlan": 2**40, "enabled": True},
        "firewallrule": {"_id": "r", "name": "n", "rule_index": 2.9, "enabled": "yes"},
        "routing": {"_id": "t"},
    }
    files = {f"{name}.bson": bson.encode(doc) for name, doc in docs.items()}
    blobs = spark.createDataFrame([("p", archive(files))], "path string, content binary")
    read = backup.documents(backup.scanned(backup.archives(blobs))).cache()
    group, wlan, rule, route = (backup.typed(read, name).first() for name in docs)
    assert (group.site_id, group.name, group.group_members) == ("s", "n", ["a", "b"])
    assert (wlan.name, wlan.vlan, wlan.enabled, wlan.is_guest) == (None, 2**31 - 1, True, None)
    assert (rule.rule_index, rule.enabled) == (2, None) and route.name is None
    for name in backup.SPECS:
        assert backup.typed(read, name).count() == (name in docs)
    assert backup.opaque(read).count() == 0


def test_redaction_at_any_depth(spark):
    doc = {"_id": "a", "x_shadow": "h", "nested": {"x_password": "p", "keep": 1}, "list": [{"secret": "s", "n": 2}, 3]}
    read = backup.documents(backup.scanned(backup.archives(spark.createDataFrame([("p", archive({"site.bson": bson.encode(doc)}))], "path string, content binary"))))
    row = read.first()
    assert row.secrets == ["x_shadow", "nested.x_password", "list.secret"]
    assert json.loads(row.body_redacted) == {"_id": "a", "x_shadow": "<redacted>", "nested": {"x_password": "<redacted>", "keep": 1}, "list": [{"secret": "<redacted>", "n": 2}, 3]}
    assert json.loads(row.body)["nested"]["x_password"] == "p"


def test_types_round_trip_and_deep_nesting(spark):
    doc = {"o": bson.Typed("objectId", "00" * 12), "d": bson.Typed("datetime", 0), "r": bson.Typed("regex", ("a", "i")), "t": bson.Typed("timestamp", (5, 6)), "b": bson.Typed("binary", (0, b"xy"))}
    fields, _ = bson.document(bson.encode(doc))
    assert bson.plain("document", fields) == {"o": {"$oid": "00" * 12}, "d": {"$date": "1970-01-01T00:00:00.000Z"}, "r": {"$regex": "a", "$options": "i"}, "t": {"$timestamp": {"t": 5, "i": 6}}, "b": {"$binary": "eHk=", "$subtype": "00"}}
    deep: dict = {}
    for _ in range(150):
        deep = {"a": deep}
    files = {"a.bson": bson.encode({"_id": "x"}) + bson.encode(deep) + bson.encode({"_id": "z"}), "b.bson": bson.encode({"_id": "y"})}
    scan = backup.scanned(backup.archives(spark.createDataFrame([("p", archive(files))], "path string, content binary"))).cache()
    assert sorted((r.entry, r.id) for r in backup.documents(scan).collect()) == [("a.bson", "x"), ("a.bson", "z"), ("b.bson", "y")]
    assert [(r.code, r.message) for r in scan.filter("kind = 'problem'").collect()] == [("bsonMalformedDocument", "a.bson: nested too deep")]


def test_containers_by_name_path_and_trial(spark):
    key, iv = b"0123456789abcdef", b"fedcba9876543210"
    inner = archive({"db.gz": gzip.compress(bson.encode({"collection": "site"}) + bson.encode({"_id": "s"}))})
    inner += b"\0" * (-len(inner) % 16)
    secret = bytes(spark.createDataFrame([(inner,)], "c binary").selectExpr(f"substring(aes_encrypt(c, X'{key.hex()}', 'CBC', 'PKCS', X'{iv.hex()}'), 17, length(c)) AS c").first().c)
    files = {"name": {"z.UNF": secret, "a": b"x"}, "path": {"d/network.x": secret, "b": b"0" * 64}, "trial": {"d/blob": secret, "other": b"0" * 640}, "none": {"a": b"x"}, "own": {"site.bson": bson.encode({"_id": "o"})}, "both": {"x.unf": secret, "site.bson": bson.encode({"_id": "o"})}, "broken": {"x.unf": b"0" * 32, "site.bson": bson.encode({"_id": "o"})}}
    blobs = spark.createDataFrame([(k, archive(v)) for k, v in files.items()], "path string, content binary")
    found = backup.opened(blobs, key, iv)
    scan = backup.scanned(found)
    assert {(r.path, r.id) for r in backup.typed(backup.documents(scan), "site").collect()} == {("name", "s"), ("path", "s"), ("trial", "s"), ("own", "o"), ("both", "s"), ("broken", "o")}
    told = backup.diagnostics(found, scan)
    assert "none" in {r.path for r in told.filter("code = 'configurationDatabaseMissing'").collect()}


def test_keys_of_paths_stay_whole(spark):
    ids = ["0" * 20 + "0001", "0" * 20 + "0002"]
    top = spark.createDataFrame([(i,) for i in ids], "id string")
    below = spark.createDataFrame([("c" + i[-1], i) for i in ids], "id string, up string")
    found = tree.nodes([tree.Level("a", top, "id", None, F.col("id")), tree.Level("b", below, "id", "up", F.col("id"))])
    assert {r.node_id for r in tree.descendants(found, "a:" + ids[0]).collect()} == {"b:c1"}


def scan_of(spark, content, **kw):
    return backup.scanned(backup.archives(spark.createDataFrame([("p", content)], "path string, content binary")), **kw)


def docs(*ids):
    return b"".join(bson.encode({"_id": i, "x": "y" * 50}) for i in ids)


def test_gzip_members_and_truncation(spark):
    two = gzip.compress(bson.encode({"collection": "site"}) + docs("a")) + gzip.compress(docs("b")) + b"\0" * 7
    rubbish = gzip.compress(docs("a")) + b"rubbish"
    cut = gzip.compress(docs(*map(str, range(2000))))[:-900]
    files = {"site.bson": two, "user.bson": rubbish, "admin.bson": cut, "account.bson": b"\x1f\x8b\x08broken", "plain.bson": docs("c")}
    scan = scan_of(spark, archive(files)).cache()
    read = {r.entry: r.n for r in backup.documents(scan).groupBy("entry").agg(F.count("*").alias("n")).collect()}
    assert read["site.bson"] == 3 and read["user.bson"] == 1 and read["plain.bson"] == 1 and 100 < read["admin.bson"] < 2000 and "account.bson" not in read
    told = {(r.code, r.message.split(":")[0]) for r in scan.filter("kind = 'problem'").collect()}
    assert told == {("zipEntryUnreadable", n) for n in ("user.bson", "admin.bson", "account.bson")}
    whole = backup.documents(scan_of(spark, archive({"db.gz": two}))).select("collection", "id").collect()
    assert [tuple(r) for r in whole] == [("site", "a"), ("site", "b")]
    lost = scan_of(spark, archive({"db.gz": b"\x1f\x8b\x08broken"})).filter("kind = 'problem'").collect()
    assert [(r.severity, r.code) for r in lost] == [("error", "configurationDatabaseMissing")]


def header(name, data, method, packed, flags=0, size=None):
    import struct
    import zlib

    return b"PK\x03\x04" + struct.pack("<HHHHHIIIHH", 20, flags, method, 0, 0, zlib.crc32(data), packed, len(data) if size is None else size, len(name), 0) + name.encode()


def test_archives_that_break(spark):
    import struct
    import zlib

    body = docs("a") + b"PK\x03\x04 PK\x07\x08 within"
    tell = lambda data, packed: struct.pack("<III", zlib.crc32(data), packed, len(data))
    stored = header("a.bin", body, 0, 0, 8) + body + b"PK\x07\x08" + tell(body, len(body))
    bare = header("b.bin", body, 0, 0, 8) + body + tell(body, len(body))
    packer = zlib.compressobj(wbits=-15)
    raw = packer.compress(docs("d")) + packer.flush()
    streamed = header("site.bson", docs("d"), 8, 0, 8) + raw + b"PK\x07\x08" + tell(docs("d"), len(raw))
    odd = header("odd", b"x", 99, 1) + b"x"
    bad = header("bad.bson", b"", 8, 4) + b"\xff\xff\xff\xff"
    cut = header("user.bson", docs("e"), 0, len(docs("e"))) + docs("e")[:20]
    scan = scan_of(spark, stored + bare + streamed + odd + bad + cut).cache()
    assert {(r.entry, r.bytes) for r in scan.filter("kind = 'entry'").collect()} == {("a.bin", len(body)), ("b.bin", len(body)), ("site.bson", len(docs("d")))}
    assert [(r.collection, r.id) for r in backup.documents(scan).collect()] == [("site", "d")]
    told = [(r.severity, r.code) for r in scan.filter("kind = 'problem'").collect()]
    assert told == [("info", "zipRecoveryMode")] + [("warning", "zipEntryUnreadable")] * 3
    assert [(r.severity, r.code) for r in scan_of(spark, b"PK\x03\x04").collect()[1:]] == [("error", "zipUnreadable")]


def test_identity_that_cannot_be_read(spark):
    told = lambda **files: backup.identity(scan_of(spark, archive({"site.bson": docs("a")} | files))).first()
    far = told(timestamp=str(2**63 - 1), version=b"\xff\xfe", format=b"\xff")
    assert (far.timestamp, far.version, far.format) == (None, None, None)
    assert [t.code for t in far.told] == ["versionUnparseable", "formatUnparseable", "timestampUnparseable", "siteExportDetected"]
    assert [t.code for t in told(timestamp="nonsense", **{"admin.bson": docs("r")}).told] == ["timestampUnparseable", "settingsOnlyDetected"]
    assert told(timestamp="2024-04-20T08:00:00.5Z").timestamp is not None and told(timestamp="2024-04-20").timestamp is None
    whole = told(**{"admin.bson": docs("r"), "db_stat.gz": b"", "version": "﻿ 9 \r\n"})
    assert (whole.kind, whole.version, whole.told) == ("full", "9", [])


def test_one_collection_in_several_entries(spark):
    scan = scan_of(spark, archive({"a/site.bson": docs("x"), "b/site.bson": docs("y")})).cache()
    assert [r.id for r in backup.documents(scan).orderBy("seq", "offset").collect()] == ["x", "y"]
    assert [(r.code, r.collection) for r in scan.filter("kind = 'problem'").collect()] == [("other", "site")]


def test_streams_take_bounded_memory():
    import os
    import subprocess
    import sys

    code = """
import gzip, resource, sys
from lodestone.sources import bson
from lodestone.sources.archive import gunzipped
doc = bson.encode({"_id": "a", "x": "y" * 100_000})
def chunks():  # a gigabyte of documents, some of it packed at a time
    import zlib
    z = zlib.compressobj(1, wbits=31)
    for _ in range(10_000):
        some = z.compress(doc)
        if some: yield some
    yield z.flush()
told = []
before = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
n = sum(fields is not None for _, fields, _ in bson.stream(gunzipped(chunks(), told)))
print(n, told, (resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before) // 1024)
"""
    out = subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, env=os.environ | {"PYTHONPATH": ":".join(p for p in sys.path if p)}, timeout=300)
    n, told, mb = out.stdout.split()
    assert (n, told) == ("10000", "[]") and int(mb) < 100, out.stdout + out.stderr


def test_encryption_round_trip(spark):
    key, iv = b"0123456789abcdef", b"fedcba9876543210"
    for content in (b"PK\x03\x04" + b"x" * n for n in (1, 12, 13, 1000)):
        row = spark.createDataFrame([("p", content)], "path string, content binary").withColumn("content", backup.encrypted("content", key, iv))
        assert bytes(backup.archives(row, key, iv).first().content) == content + b"\0" * (-len(content) % 16)


def test_equality_of_documents():
    same = lambda a, b: bson.fingerprint(bson.document(bson.encode(a))[0]) == bson.fingerprint(bson.document(bson.encode(b))[0])
    assert same({"a": 1, "b": [1.5, {"c": None}]}, {"a": 1, "b": [1.5, {"c": None}]}) and same({"a": -0.0}, {"a": 0.0})
    for other in ({"b": 2, "a": 1}, {"a": 1.0, "b": 2}, {"a": 1}, {"a": 1, "b": [2]}, {"a": "1", "b": 2}):
        assert not same({"a": 1, "b": 2}, other)


def test_values_are_set_and_taken_out(spark):
    read = backup.documents(scan_of(spark, archive({"a.bson": bson.encode({"_id": "a", "n": 1, "m": 2**40, "d": 1e300})})))
    names = lambda column: [f.key + "=" + f.display for f in read.select(column.alias("x")).first().x]
    assert names(backup.with_field("n", "string", F.lit("new"))) == ["_id=a", "n=new", f"m={2**40}", "d=1e+300"]
    assert names(backup.with_field("z", "string", F.lit("new")))[-1] == "z=new"
    assert names(backup.with_field("n", "string", F.lit(None))) == ["_id=a", f"m={2**40}", "d=1e+300"]
    assert names(backup.with_field("z", "string", F.lit(None))) == ["_id=a", "n=1", f"m={2**40}", "d=1e+300"]
    row = read.select(backup.int64_value("m").alias("m"), backup.int64_value("d").alias("d"), backup.double_value("n").alias("n"), backup.field_type("zz").alias("t")).first()
    assert (row.m, row.d, row.n, row.t) == (2**40, None, 1.0, None)


def test_exports_as_the_fixed_cases(spark, tmp_path):
    wlan = {"_id": "w1", "name": "Home | é\U0001f468‍\U0001f469", "x_passphrase": "supersecret", "security": "wpapsk", "enabled": True, "nested": {"x_password": "deep"}}
    files = {"version": "9.5.21", "format": "8", "timestamp": "1700000000000", "site.bson": bson.encode({"_id": "s", "name": "n"}), "wlanconf.bson": bson.encode(wlan | {"site_id": "s"})}
    blobs = spark.createDataFrame([("p", archive(files)), ("q", archive(files)), ("empty", archive({"version": "1", "site.bson": b""}))], "path string, content binary")
    scan = backup.scanned(backup.archives(blobs)).cache()
    nodes = backup_tree.nodes(backup.documents(scan)).cache()

    def text(kind, preset, secrets, path="p", tree=nodes):
        parts = export.whole(backup_tree.sections(tree, secrets), backup.identity(scan), kind, preset, secrets)
        return "".join(r.text for r in parts.filter(F.col("path") == path).orderBy("key").collect())

    out = text("json", "gpt", False)
    root = json.loads(out)
    assert '"targetModel" : "gpt"' in out and root["header"]["selectionCount"] == len(root["sections"]) == 2 and root["header"]["timestamp"] == "2023-11-14T22:13:20Z"
    assert "<redacted>" in out and "supersecret" not in out and "deep" not in out and root["sections"][1]["raw"]["nested"] == {"x_password": "<redacted>"}
    assert json.loads(text("json", "gpt", False, "empty"))["sections"] == []
    out = text("markdown", "claude", False)
    assert '<wlan title="Home | ' in out and "</wlan>" in out and "| name | Home \\| " in out and "supersecret" not in out and "```json\n{" in out
    assert "## Wlan: Home" in text("markdown", "gpt", False)
    out = text("text", "gpt", True)
    assert "supersecret" in out and "INCLUDES secrets" in out and "[note]" not in out and "WLAN: Home" in out
    export.register_preset("tiny", 10, title="Tiny")
    n = export.lengths(export.whole(backup_tree.sections(nodes, True), backup.identity(scan), "text", "tiny", True).filter(F.col("key") != export.FOOT), "tiny").filter("path = 'p'").first()
    assert n.over and f"This export is ~{n.n} characters, exceeding the suggested budget for Tiny (~10)" in text("text", "tiny", True)
    hidden = backup.scanned(backup.archives(blobs), secrets=frozenset({"security"}))
    out = text("text", "gpt", False, tree=backup_tree.nodes(backup.documents(hidden)))
    assert "supersecret" in out and "wpapsk" not in out  # the names given are those of fields and raw alike
    parts = export.whole(backup_tree.sections(nodes), backup.identity(scan))
    names = export.suggested_name(backup.identity(scan), "markdown", True, F.lit("2024-01-02").cast("date"))
    for _ in range(2):  # a second run replaces the first one's files
        done = {r.path: r.file for r in export.save(parts, names, f"file://{tmp_path}/out").collect()}
    assert sorted(x.name for x in (tmp_path / "out").iterdir() if not x.name.startswith(".")) == ["backup-2024-01-02-v1-INCLUDES-SECRETS.md", "backup-2024-01-02-v9.5.21-INCLUDES-SECRETS-2.md", "backup-2024-01-02-v9.5.21-INCLUDES-SECRETS.md"]
    assert (tmp_path / "out" / done["p"].rpartition("/")[2]).read_text() == "".join(r.text for r in parts.filter("path = 'p'").orderBy("key").collect())


def test_a_repeated_attempt_of_the_sink_changes_nothing(spark, tmp_path):
    parts = spark.createDataFrame([(f"p{i}", str(k), f"{i}-{k};") for i in range(20) for k in range(5)], "path string, key string, text string")
    names = spark.createDataFrame([(f"p{i}", f"f{i}.txt") for i in range(20)], "path string, name string")
    (tmp_path / "out" / "_attempts-old").mkdir(parents=True)
    (tmp_path / "out" / "_attempts-old" / "0-0-0").write_text("what a late attempt of another run has left")
    export.save(parts, names, f"{tmp_path}/out")
    found = {x.name: x.read_text() for x in (tmp_path / "out").glob("f*")}
    assert found == {f"f{i}.txt": "".join(f"{i}-{k};" for k in range(5)) for i in range(20)}
    assert [x.name for x in (tmp_path / "out").glob("_attempts*")] == ["_attempts-old"]


def test_trees_of_odd_backups(spark):
    site = lambda i, **more: bson.encode({"_id": i} | more)
    files = {
        "site.bson": site("s") + site("s", desc="twin") + site("t"),
        "user.bson": bson.encode({"_id": "u", "site_id": "s"}) + bson.encode({"_id": "v", "site_id": "gone"}) + bson.encode({"_id": "w"}),
        "routing.bson": bson.encode({"_id": "r", "site_id": "s"}),
        "wlanconf.bson": bson.encode({"_id": "w", "site_id": "s", "wlangroup_id": "g"}),
        "wlangroup.bson": bson.encode({"_id": "g", "site_id": "t"}),
        "b.bson": bson.encode({"x": 1}), "a.bson": bson.encode({"_id": 5}),
    }
    found = backup.documents(scan_of(spark, archive(files)))
    nodes = backup_tree.nodes(found).cache()
    got = [r.node_id for r in nodes.orderBy("key").collect()]
    below = ["sitechild:s:wlans", "wlan:w", "sitechild:s:clients", "client:u"]
    assert got == ["cat:sites", "site:s", *below, "site:s", *below, "site:t", "sitechild:t:wlans", "wlangroup:g", "cat:opaque", "opcoll:a", "oprec:a:5", "opcoll:b", "oprec:b:"]
    assert "rt:r" in {r.node_id for r in backup_tree.nodes(found, lone_routes=True).collect()}
    chosen = spark.createDataFrame([("p", "site:t"), ("p", "wlangroup:g"), ("p", "none"), ("q", "cat:sites")], "path string, node_id string")
    assert {r.node_id for r in backup_tree.selected(nodes, chosen).collect()} == {"site:t", "sitechild:t:wlans", "wlangroup:g"}
    off = backup_tree.toggled(nodes, backup_tree.selected(nodes, chosen), spark.createDataFrame([("p", "wlangroup:g")], "path string, node_id string"), False)
    assert {r.node_id for r in off.collect()} == {"site:t", "sitechild:t:wlans"}
    assert {(r.node_id, r.hit) for r in backup_tree.found(nodes, "GONE").collect()} == set()
    assert backup_tree.found(nodes, "").count() == nodes.count()
    refs = {(r.id, r.target_id, r.found) for r in backup_tree.references(found).filter("field = 'site_id'").collect()}
    assert refs == {("u", "s", True), ("v", "gone", False), ("r", "s", True), ("w", "s", True), ("g", "t", True)}
    assert backup_tree.nodes(found.limit(0)).collect() == []


@pytest.mark.parametrize("plans", [archives, star])
def test_archives_are_made_and_decoded_by_all_tasks(spark, plans):
    found = plans._backups(lambda name: spark.read.parquet(f"/root/testdata/sf0.01/{name}.parquet"))
    assert found.rdd.getNumPartitions() == int(spark.conf.get("spark.sql.shuffle.partitions"))


def test_exports_to_files_scan_once(spark, monkeypatch):
    scans, scan = [], archives._scan
    monkeypatch.setattr(archives, "_scan", lambda t: scans.append(1) or scan(t))
    assert archives.QUERIES["backup_export_files"](spark, "/root/testdata/sf0.001").count() == 25
    assert len(scans) == 1
