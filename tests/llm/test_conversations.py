"""The prefix trie and the repair of conversations against brute force, on odd rows and on a whole table."""

import hashlib
import random
import re
import zlib
from collections import defaultdict
from functools import lru_cache

import duckdb
import pytest
from pyspark.sql import functions as F

from lodestone.llm import common, conversation_repair, prefix_trie, queries

SF = "/root/testdata/sf0.01/conversations.parquet"
KIND = "conv_id long, turn long, role string, text string"


def odd_rows(seed):
    """Null turns, roles, texts and ids, repeated rows, one turn with several rows, negative ids, long chains of prefixes."""
    rng = random.Random(seed)
    rows = [(1, None, "user", "a."), (1, None, "user", "a."), (1, None, None, None), (1, 0, "system", "x."), (1, 0, "", "x."), (None, 1, "user", "b"), (-7, 2, "assistant", "z."), (-7, 9, "user", "z.")]
    rows += [(2, 5, "assistant", "é!\n "), (2, 5, "user", ""), (3, 1, "u", "q?")]
    rows += [(i, t, rng.choice("ua"), rng.choice(["x", "é.", "", None])) for i in range(10, 120) for t in range(rng.randrange(9))]
    rows += [(i, t, r, x) for i in range(200, 230) for t, r, x in ((0, "user", "a."), (1, "assistant", "b"), (1, "assistant", "c."), (3, "system", "s."))]
    rows += [(1000 + i, t, "u", "x") for i in range(30) for t in range(i % 7)] + [(2000 + i, t, "u", "x") for i in range(3) for t in range(200 + i)]
    rng.shuffle(rows)
    return rows


def clash(df):
    return df.select("*", *(F.lit(1).alias(c) for c in ("Conv_Id", "_id", "path", "digest", "mark", "fault", "row", "audit")))


def mod(a, b):
    return a - b * int(a / b)


def brute_nodes(rows, rebuild):
    by = defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            role, text = role or "", text or ""
            by[conv].append((turn is not None, turn or 0, role.encode(), hashlib.md5(f"{len(role)}:{role}{text}".encode()).hexdigest(), (role, text)))
    by = {k: [x[-1] for x in sorted(v)] for k, v in by.items()}
    strings = {k: by.get(k - mod(k, 5), [])[: (h := zlib.crc32(str(k).encode()) % 9)] + v[h:] if rebuild else v for k, v in by.items()}
    members, kids, sums, out = defaultdict(list), defaultdict(list), {}, []
    for k, v in strings.items():
        for d in range(len(v) + 1):
            members[tuple(v[:d])].append(k)
    for n in members:
        if n:
            kids[n[:-1]].append(n)
    for n in sorted(members, key=lambda n: -len(n)):
        own = (len(members[n]) - 1) * len(n[-1][1].encode()) if n else 0
        sums[n] = sum(sums[k][0] for k in kids[n]) or 1, sum(sums[k][1] for k in kids[n]) + own
        ends = ",".join(map(str, sorted(k for k in members[n] if len(strings[k]) == len(n))))
        out.append((min(members[n]), len(n), min(members[n[:-1]]) if n else None, len(members[n]), len(kids[n]), *sums[n], hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=repr)


def nodes_of(df):
    return sorted((tuple(r) for r in df.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256").collect()), key=repr)


def test_two_fattest_numbers():
    for low in range(40):
        for high in range(low + 1, 60):
            assert prefix_trie.two_fattest(low, high) == max(range(low + 1, high + 1), key=lambda x: x & -x)


@pytest.mark.parametrize("parts", [1, 7])
@pytest.mark.parametrize("rebuild", [True, False])
def test_prefix_trie_as_brute_force(spark, rebuild, parts):
    rows = odd_rows(parts)
    found = clash(spark.createDataFrame(rows, KIND))
    before = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        spark.conf.set("spark.sql.shuffle.partitions", parts)
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
        got = nodes_of(prefix_trie.rebuilt_nodes(found) if rebuild else prefix_trie.prefix_nodes(found))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert got == brute_nodes(rows, rebuild)


@pytest.mark.parametrize("size", [1, 3])
def test_prefix_trie_in_many_batches(spark, monkeypatch, size):
    """A node's children may be expanded by an earlier batch than itself."""
    monkeypatch.setattr(prefix_trie, "written", lambda df, name, batch_rows=0: common.written(df, name, size))
    rows = odd_rows(1)
    assert nodes_of(prefix_trie.rebuilt_nodes(spark.createDataFrame(rows, KIND).coalesce(1))) == brute_nodes(rows, True)


def test_prefix_trie_orders_one_turn_as_its_sql(spark, tmp_path):
    """Rows of one turn and role stand by text."""
    rng = random.Random(4)
    rows = [(i, rng.choice([None, None, 1, 2]), rng.choice(["u", "", "a"]), rng.choice(["x", "é.", "", "y", "zz"])) for i in range(60) for _ in range(rng.randrange(9))]
    spark.createDataFrame(rows, KIND).coalesce(1).write.parquet(f"{tmp_path}/conversations.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW conversations AS SELECT * FROM '{tmp_path}/conversations.parquet/*.parquet'")
    columns = "conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256"
    want = con.execute(f"SELECT {columns} FROM ({prefix_trie.SQL})").fetchall()
    assert nodes_of(queries.QUERIES["op11_prefix_trie"](spark, str(tmp_path))) == sorted(want, key=repr)


def test_prefix_trie_of_the_whole_table(spark):
    found = spark.read.parquet(SF)
    assert nodes_of(prefix_trie.rebuilt_nodes(found)) == brute_nodes([tuple(r) for r in found.select("conv_id", "turn", "role", "text").collect()], True)


def test_prefix_trie_of_no_rows(spark):
    assert prefix_trie.rebuilt_nodes(spark.createDataFrame([], KIND)).collect() == []
    assert prefix_trie.rebuilt_nodes(spark.createDataFrame([(None, 1, "user", "x")], KIND)).collect() == []


def test_batches_of_any_size_make_one_trie():
    rng = random.Random(2)
    found = sorted({bytes(rng.choice(b"ab") for _ in range(rng.randrange(12))) for _ in range(200)})
    make = lambda x, i: prefix_trie.String(b"".join(hashlib.md5(bytes([c])).digest() for c in x), prefix_trie.np.ones(len(x), dtype=int), i, 1, "")
    for size in (1, 3, 1000):
        strings = [make(x, i) for i, x in enumerate(found)]
        rng.shuffle(strings)
        trie = prefix_trie.ZFastTrie(strings[0])
        for low in range(0, len(strings), size):
            trie.insert(strings[low : low + size])
        ends, todo = set(), [trie.root]
        while todo:
            node = todo.pop()
            ends |= {node.conv} - {None}
            assert node is trie.root or node.conv is not None or len(node.kids) > 1  # compacted
            todo += node.kids.values()
        assert ends == set(range(len(found)))
        assert all(trie.above_exit(s).size == s.size for s in strings)


@lru_cache(maxsize=100_000)
def brute_audit(rows):
    after = {"": "su", "s": "u", "u": "a", "a": "u"}

    @lru_cache(None)
    def go(i, state, inserts):
        ways, to = [(0, "")] if i == len(rows) and state in ("", "a") else [], "a" if state == "u" else "u"
        step = lambda cost, edit, rest: ways.append((rest[0] + cost, edit + rest[1])) if rest else None
        if inserts < 3:
            step(3, "I", go(i, to, inserts + 1))
        if i < len(rows):
            initial, stays = "sua?"[rows[i] % 4], 3 if rows[i] // 4 == 2 else 0
            step(4, "D", go(i + 1, state, 0))
            if rows[i] // 4 != 1:
                if initial in after[state]:
                    step(stays, "K", go(i + 1, initial, 0))
                step(stays + 3, "R", go(i + 1, to, 0))
        return min(ways, default=None)

    return go(0, "", 0)


def test_audits_are_the_cheapest_and_least():
    rng = random.Random(5)
    for k in range(4000):
        faults, roles = rng.choice([[0, 0, 0, 0, 1, 2], [1, 1, 1, 0], [0], [2, 2, 0]]), rng.choice([[0, 1, 2, 3], [0, 0, 1], [1, 2], [3, 3, 0]])
        rows = bytes(rng.choice(roles) + 4 * rng.choice(faults) for _ in range(rng.randrange(100 if k % 50 == 0 else 14)))
        assert conversation_repair.audit(rows) == brute_audit(rows)


def test_a_long_conversation_takes_little():
    cost, audit = conversation_repair.audit(bytes([1, 2]) * 200_000)
    assert (cost, set(audit), len(audit)) == (0, {"K"}, 400_000)


def brute_repairs(rows):
    by = defaultdict(list)
    for row in rows:
        if row[0] is not None:
            by[row[0]].append(row)
    out = {}
    for conv, own in by.items():
        found = []
        for _, turn, role, text in own:
            role, text = " " if role is None else role, " " if text is None else text
            code = zlib.crc32(f"{conv}:{' ' if turn is None else turn}".encode()) % 20
            text = "" if code == 1 else re.sub("[.!?]", "", text) if code == 2 else text
            found += [(turn, "user" if code == 4 else role, text)] * (0 if code == 0 else 2 if code == 3 else 1)
        found.sort(key=lambda x: (x[0] is not None, x[0] or 0, x[1].encode(), hashlib.md5(x[2].encode()).digest()))
        seen, faults, codes, text, state, at = set(), [], [], [], "", 0
        for _, role, body in found:
            shown = re.findall(r"[^\x20\x09-\x0D]", body)
            faults.append(1 if not shown else 2 if (role, body) in seen else 3 if shown[-1] not in ".!?" else 0)
            seen.add((role, body))
            codes.append(("sua".find(role[:1]) if role and role[0] in "sua" else 3) + (0, 4, 4, 8)[faults[-1]])
        cost, audit = brute_audit(bytes(codes))
        for edit in audit:
            to = "a" if state == "u" else "u"
            if edit != "I":
                _, role, body = found[at]
                at += 1
            if edit != "D":
                state = role[:1] if edit == "K" else to
                text.append(f"{role if edit == 'K' else 'user' if to == 'u' else 'assistant'}:{'' if edit == 'I' else body}")
        turns = {t for t, _, _ in found if t is not None}
        illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(found, found[1:], strict=False))
        out[conv] = (max(turns) - min(turns) + 1 - len(turns) if turns else 0, *map(faults.count, (1, 2, 3)), illegal, cost, audit, hashlib.sha256("\n".join(text).encode()).hexdigest())
    return out


@pytest.mark.parametrize("odd", [True, False])
def test_repair_as_brute_force(spark, odd):
    found = clash(spark.createDataFrame(odd_rows(3), KIND)) if odd else spark.read.parquet(SF)
    rows = odd_rows(3) if odd else [tuple(r) for r in found.select("conv_id", "turn", "role", "text").collect()]
    got = conversation_repair.repair_damaged(found).collect()
    assert {r[0]: tuple(r)[1:] for r in got} == brute_repairs(rows) and len(got) == len({r[0] for r in rows} - {None})


def test_repaired_rows_are_conversations(spark):
    found = spark.read.parquet(SF)
    rows = conversation_repair.repaired(conversation_repair.damaged(found)).collect()
    by = defaultdict(list)
    for r in sorted(rows, key=lambda r: (r.conv_id, r.place)):
        by[r.conv_id].append(r)
    assert by and all(re.fullmatch("(s?(ua)+)?", "".join(r.role[0] for r in v)) and [r.place for r in v] == list(range(1, len(v) + 1)) for v in by.values())
    assert conversation_repair.repair_damaged(spark.createDataFrame([], KIND)).collect() == []
