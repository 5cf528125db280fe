"""Edge cases of each operator on small tables: nulls, empty texts and tables, ties, repeated rows, clashing columns."""

import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers as P
import pyarrow as pa
import pytest
import tiktoken
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from lodestone.llm import byte_bpe, common, exact_dedup, language_id, line_dedup, near_dedup, neighbours, packing, queries, toxicity, url_filter, warc

BPE, WORDS = P.path("byte_bpe_multi_50k.tiktoken"), P.path("word_bpe_49k.json")
DOCS = "doc_id long, text string, lang string, source string, n_chars long"
LONG = " ".join(f"w{i}" for i in range(6000))
ROWS = [
    (1, "the cat sat on the mat today", "en", "s", 1),
    (2, "the  cat sat on the mat today ", None, "s", 1),
    (3, None, None, None, None),
    (4, "", "en", "s", 0),
    (5, LONG, "en", "t", 1),
    (6, LONG + " end", "en", "t", 1),
    (6, LONG + " end", "en", "t", 1),
    (None, "no id", "en", "s", 1),
    (7, "\t\n", "fr", "s", 1),
    (8, "日本語 ﬁ 😀 ß", "fr", "s", 1),
]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, DOCS)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


def clash(df):
    """With extra columns under names that operators use."""
    more = {"kept": "x", "_digest": 1, "id": 2, "TEXT": "other", "score": 3, "a": 0, "key": 0, "_c0": 1, "Doc_Id": 5}
    return df.select("*", *(F.lit(v).alias(k) for k, v in more.items()))


def by_id(df, *columns):
    return sorted((tuple(r[c] for c in columns) for r in df.collect()), key=repr)


def test_warc_round_trip(spark):
    pages = spark.createDataFrame([(1, "http://a/x y\r\n", "<p>é</p>"), (2, None, "<p>é</p>"), (3, "u", None), (4, "u", ""), (5, "u", "z" * 300_000), (0, "v", "<p>é</p>")], "page_id long, url string, html string")
    got = {r.page_id: r for r in warc.page_records(spark, pages.withColumn("digest", F.lit(1)), split_bytes=97).collect()}
    assert len(got) == 6
    assert [(got[i].record_type, got[i].refers_to, got[i].payload_bytes) for i in (0, 1, 2, 3, 4, 5)] == [("response", None, 9), ("revisit", 0, 9), ("revisit", 0, 9), ("response", None, 0), ("revisit", 3, 0), ("response", None, 300_000)]
    assert got[1].payload_digest == got[0].payload_digest == warc._digest("<p>é</p>".encode())
    assert warc.page_records(spark, pages.limit(0)).count() == 0


def test_warc_of_null_and_repeated_ids(spark):
    rows = [(None, "n", "same"), (2, "a", "same"), (1, "b", "same"), (1, "b", "same"), (None, "x", "alone"), (None, "y", "nulls"), (None, "z", "nulls"), (9, "e", None), (8, "e", "")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    for some in (pages, pages.repartition(3)):
        got = sorted(((r.page_id, r.record_type, r.refers_to, r.payload_bytes) for r in warc.page_records(spark, clash(some.drop("Doc_Id"))).collect()), key=repr)
        assert got == sorted([(None, "revisit", 1, 4), (2, "revisit", 1, 4), (1, "response", None, 4), (1, "response", None, 4), (None, "response", None, 5), (None, "response", None, 5), (None, "response", None, 5), (9, "revisit", 8, 0), (8, "response", None, 0)], key=repr)
    assert warc.page_records(spark, pages.limit(0)).collect() == []


def test_warc_reads_committed_attempts_only(spark, tmp_path):
    pages = spark.createDataFrame([(i, "u", f"page {i}") for i in range(50)], "page_id long, url string, html string")
    manifest = warc.write_archives(pages, f"file://{tmp_path}/w")
    names = [x.name for x in (tmp_path / "w").iterdir()]
    for name in names:  # what attempts that failed or came late leave
        (tmp_path / "w" / name.replace(".warc", "9.warc")).write_bytes((tmp_path / "w" / name).read_bytes()[:-5])
    assert warc.read_archives(manifest).count() == 50 and {r.path.rpartition("/")[2] for r in manifest.collect()} == {n for n in names if not n.startswith(".")}


def test_warc_split_at_any_place(spark, tmp_path):
    random.seed(1)
    pages = spark.createDataFrame([(i, "u", "".join(random.choice("abc") for _ in range(random.randint(0, 900)))) for i in range(60)], "page_id long, url string, html string")
    manifest = warc.write_archives(pages, f"file://{tmp_path}/w")
    for split in (11, 1000, 1 << 20):
        got = warc.read_archives(manifest, split)
        assert sorted(r.record_id for r in got.collect()) == sorted(f"urn:page:{i}" for i in range(60))


def test_byte_bpe_as_the_library(spark, docs, empty):
    e = byte_bpe.encoder(BPE, P.PATTERN)
    lib = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=e.ranks, special_tokens={})
    random.seed(2)
    parts = ["a", "the", "  ", "\n", " ", "é", "日本", "😀", "1", "'s", "'LL", "...", " ", "\x1c", "aaaa", "\t", "İ", "́"]
    for _ in range(2000):
        x = "".join(random.choice(parts) for _ in range(random.randint(0, 14)))
        assert e.encode(x) == lib.encode_ordinary(x)
    for r in byte_bpe.round_trip(clash(docs), BPE, P.PATTERN).collect():
        text = next((t or "") for i, t, *_ in ROWS if i == r.doc_id)
        ids = lib.encode_ordinary(text)
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (len(ids), hashlib.sha256(np.array(ids, dtype="<u4").tobytes()).hexdigest(), hashlib.sha256(text.encode()).hexdigest())
    assert byte_bpe.round_trip(empty, BPE, P.PATTERN).count() == 0


def test_byte_bpe_appends_and_edits():
    e = byte_bpe.encoder(BPE, P.PATTERN)
    random.seed(3)
    tokens = list(e.tokens.values())
    for _ in range(60):
        data = b"".join(random.choice(tokens) for _ in range(30))
        last = e.table(data)
        a = random.randint(0, len(data))
        b = random.randint(a, min(len(data), a + 9))
        new = random.choice(tokens)
        assert e.edit(data, last, a, b, new) == (lambda d: (d, e.table(d)))(data[:a] + new + data[b:])
        assert e.append(data, last, new) == (data + new, e.table(data + new))


def test_exact_dedup(docs, empty):
    got = by_id(exact_dedup.exact_dedup(clash(docs)), "doc_id", "keep_id", "group_size", "kept")
    assert (1, 2, 2, False) in got and (2, 2, 2, True) in got  # the longer original stays
    assert (7, 7, 3, True) in got and (3, 7, 3, False) in got and (4, 7, 3, False) in got
    assert sorted(x for x in got if x[0] == 6) == [(6, 6, 2, False), (6, 6, 2, True)]
    kept = exact_dedup.drop_copies(clash(docs))
    assert kept.columns == clash(docs).columns and kept.count() == 6
    assert exact_dedup.exact_dedup(empty).count() == 0
    # a filter too small for the rows gives the same result
    assert by_id(exact_dedup.exact_dedup(docs, max_bits=64), "doc_id", "keep_id") == by_id(exact_dedup.exact_dedup(docs), "doc_id", "keep_id")


def brute_groups(rows):
    sets = {}
    for i, text in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        sets[i] = {tuple(w)} if 0 < len(w) < 5 else {tuple(w[k : k + 5]) for k in range(len(w) - 4)}
    alike = [(a, b) for a in sets for b in sets if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b])]
    root = {i: i for i in sets}
    while any(root[a] != root[b] for a, b in alike):
        for a, b in alike:
            root[a] = root[b] = min(root[a], root[b])
    return sorted((i, len(sets[i]), root[i], i == root[i]) for i in sets)


def test_near_dedup_as_brute_force(spark, empty):
    random.seed(4)
    base = [" ".join(f"x{random.randint(0, 999)}" for _ in range(random.randint(3, 60))) for _ in range(12)]
    rows = [(i, base[i % 12]) for i in range(12)]
    for i in range(12, 60):
        w = base[i % 12].split(" ")
        for _ in range(random.randint(0, 2)):
            w[random.randrange(len(w))] = "Y" + str(random.randint(0, 9))
        rows.append((i, " ".join(w)))
    rows += [(60, None), (61, ""), (62, "one two"), (63, "ONE two")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert by_id(near_dedup.near_dedup(clash(docs)), "doc_id", "n_shingles", "component_id", "kept") == sorted(brute_groups(rows), key=repr)
    kept = near_dedup.drop_near_copies(clash(docs))
    assert kept.columns == clash(docs).columns and sorted(r.doc_id for r in kept.collect()) == [r[0] for r in brute_groups(rows) if r[3]]
    assert near_dedup.near_dedup(empty).count() == 0


def test_near_dedup_of_odd_rows(docs):
    got = by_id(near_dedup.near_dedup(clash(docs)), "doc_id", "component_id")
    assert (6, 5) in got and (2, 1) in got and (3, 3) in got and (None, None) in got and len(got) == len(ROWS)


def test_near_dedup_of_a_crowded_run(spark):
    """Documents with a long template in common: hundreds share each run, few are linked."""
    random.seed(8)
    template = [f"t{i}" for i in range(100)]
    rows = []
    for i in range(380):
        own = [f"o{i}x{k}" for k in range(20)]
        rows.append((2 * i, " ".join(template + own)))
        if i % 4 == 0:
            edited = template + own
            for k in (20, 104, 112):
                edited[k] = f"e{i}x{k}"
            rows.append((2 * i + 1, " ".join(edited)))
    sets = {i: {tuple(w[k : k + 5]) for k in range(len(w) - 4)} for i, w in ((i, t.split(" ")) for i, t in rows)}
    alike = [(a, b) for a in sets for b in sets if a < b and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b])]
    assert alike == [(i, i + 1) for i in range(0, 760, 8)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    want = {i: i - i % 2 for i in sets}
    assert {r.doc_id: r.component_id for r in near_dedup.near_dedup(docs).collect()} == want


def test_near_dedup_loses_no_link_into_a_dense_group(spark, monkeypatch):
    """Hundreds of near copies, and documents with few links each into the group; in one block and in many."""
    random.seed(10)
    base = [f"b{i}" for i in range(60)]
    rows = []
    for i in range(240):
        w = list(base)
        for k in random.sample(range(60), random.randint(1, 2)):
            w[k] = f"e{i}x{k}"
        if i >= 200:  # few of the copies are near enough
            for k in random.sample(range(60), 2):
                w[k] = f"f{i}x{k}"
        rows.append((i, " ".join(w)))
    want = {r[0]: r[2] for r in brute_groups(rows)}
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    for block in (512, 40):
        monkeypatch.setattr(near_dedup, "SET_BLOCK", block)
        assert {r.doc_id: r.component_id for r in near_dedup.near_dedup(docs).collect()} == want


def test_comparable_pairs_as_brute_force(spark):
    rng = np.random.default_rng(9)
    base = rng.integers(0, 1 << 32, near_dedup.HASHES, dtype=np.uint32)
    sig = np.where(rng.random((300, near_dedup.HASHES)) < rng.uniform(0.5, 0.9, (300, 1)), base, rng.integers(0, 1 << 32, (300, near_dedup.HASHES), dtype=np.uint32)).astype(np.uint32)
    part, size = rng.integers(0, 40, 300) * 1000, rng.integers(80, 120, 300)
    low = (sig & 0xFF).astype(np.uint8)
    may = {(a, b) for a in range(300) for b in range(300) if a != b and part[a] != part[b] and 100 * min(size[a], size[b]) >= 75 * max(size[a], size[b]) and (low[a] == low[b]).sum() >= near_dedup.MIN_AGREE}
    assert len(may) > 1000
    for side in (np.full(300, 2), rng.integers(0, 2, 300)):
        rows = pa.table({"side": side, "component": part, "n": size, "signature": [s.tobytes() for s in sig]})
        got = [(int(i), int(j)) for x, y in near_dedup._comparable(rows) for i, j in zip(x, y)]
        want = {frozenset(p) for p in may if side[p[0]] == 2 or side[p[0]] != side[p[1]]}
        assert len(got) == len(want) and {frozenset(p) for p in got} == want


def test_components_of_a_chain(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(100)] + [(200, 300), (300, 200), (5, 5)], "a long, b long")
    got = {r.id: r.component for r in common.components(edges).collect()}
    assert got == {i: 0 for i in range(101)} | {200: 200, 300: 200}


def test_url_filter(spark):
    urls = ["HTTP://www.Example.COM/en/7?x", "https://a.example.com/en/6", "http://x.net/de/8", "http://example.net/de/8", "http://b.org/es/", "nothing", None, "x://Ä.org#f", "http://h.net?q=/de/", "http://a.xcom/en/"]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in url_filter.judge(clash(pages.withColumn("text", F.lit(1)).drop("text")), none).collect()}
    assert got == {
        0: ("www.example.com", "/en/7", "example.com/en/7", "allow"), 1: ("a.example.com", "/en/6", "com/en/", "block"), 2: ("x.net", "/de/8", "net/de/", "block"),
        3: ("example.net", "/de/8", "example.net/de/8", "allow"), 4: ("b.org", "/es/", "org/es/", "block"), 5: ("", "", None, "allow"), 6: ("", "", None, "allow"),
        7: ("Ä.org", "", None, "allow"), 8: ("h.net", "", None, "allow"), 9: ("a.xcom", "/en/", None, "allow"),
    }
    bad = spark.createDataFrame([(i, f"http://s.example.io/{'bad' if i % 2 else 'good'}/{i}") for i in range(200)], "page_id long, url string")
    labels = spark.createDataFrame([(i, 0 if i % 2 else 1, None) for i in range(150)], "doc_id long, quality int, toxic int")
    assert {r.page_id for r in url_filter.judge(bad, labels).filter("verdict = 'block'").collect()} == set(range(1, 200, 2))
    assert url_filter.judge(bad.limit(0), labels).count() == 0


def test_url_filter_query_goes_by_its_contract(spark, tmp_path):
    urls = ["http://www.example.com/en/7", "http://x.com/en/1", "http://x.net/de/8", "http://net/de/", "http://a.example.net/de/81", "http://example.net/de/7", "http://b.org/es/", "http://b.org/e"]
    spark.createDataFrame(list(enumerate(urls)), "page_id long, url string").write.parquet(f"{tmp_path}/pages.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    got = {r.page_id: (r.rule, r.verdict) for r in queries.QUERIES["op4_url_filter"](spark, str(tmp_path)).collect()}
    assert got == {
        0: ("example.com/en/7", "allow"), 1: ("com/en/", "block"), 2: ("net/de/", "allow"), 3: ("net/de/", "allow"),
        4: ("example.net/de/8", "block"), 5: ("net/de/", "allow"), 6: ("org/es/", "block"), 7: (None, "allow"),
    }


def test_url_filter_of_deep_paths(spark):
    end = ["news", "spam"]
    urls = [f"http://s.example.io/a/b/c/d/e/f/{end[i % 2]}/{i}" for i in range(200)] + [f"http://s.example.io/a/b/c/d/{end[i % 2]}/{i}" for i in range(200)] + [f"http://deep.io/{'x/' * 300}{i}a" for i in range(2)]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    labels = spark.createDataFrame([(i, 1 - i % 2, None) for i in [*range(150), *range(200, 350)]], "doc_id long, quality int, toxic int")
    got = url_filter.judge(pages.filter("page_id <> 401"), labels).collect()
    assert {r.page_id for r in got if r.verdict == "block"} == set(range(1, 400, 2)) and len(got) == 401
    assert {r.template for r in got if r.page_id == 400} == {"/".join(["*"] * 301)}


def brute_tree(rows):
    """(template, purity) of each (host, segments, bad), by the tree's rules over plain lists."""
    names = {(h, s): list(s) for h, s, _ in rows}
    deep = max(len(s) for _, s in names)
    for k in range(deep):
        kids = {}
        for h, s, _ in rows:
            t = names[h, s]
            if len(t) > k:
                kids.setdefault((h, tuple(t[:k])), Counter())[t[k]] += 1
        wide = {x for x, c in kids.items() if len(c) >= url_filter.MANY and sum(c.values()) < len(c) * url_filter.MANY * url_filter.SHARE}
        for (h, _), t in names.items():
            if len(t) > k and (h, tuple(t[:k])) in wide:
                t[k] = "*"

    def sums(key):
        out = {}
        for h, s, bad in rows:
            if bad is not None:
                x = out.setdefault(key(h, s), [0, 0])
                x[0], x[1] = x[0] + 1, x[1] + bad
        return out

    for k in reversed(range(deep)):
        put = lambda t, k=k: tuple("*" if i == k else x for i, x in enumerate(t))
        own, pools = sums(lambda h, s: (h, tuple(names[h, s]))), sums(lambda h, s: (h, put(names[h, s])))
        for (h, _), t in names.items():
            n, bad = own.get((h, tuple(t)), (0, 0))
            all_n, all_bad = pools.get((h, put(t)), (0, 0))
            share = (all_bad + 0.5) / (all_n + 1)
            rest = all_n - n
            if len(t) > k and min(n, rest) >= url_filter.EVIDENCE and abs(bad / n - (all_bad - bad) / rest) / (share * (1 - share) * (1 / n + 1 / rest)) ** 0.5 <= url_filter.ALIKE:
                t[k] = "*"
    for h, size in {(h, len(s)) for h, s in names}:
        same = [t for (g, s), t in names.items() if g == h and len(s) == size]
        if len({tuple(t) for t in same}) == 1:
            for t in same:
                t[:] = ["*"] * size
    hosts, nodes, every = sums(lambda h, s: h), sums(lambda h, s: (h, tuple(names[h, s]))), sums(lambda h, s: 0).get(0, (0, 0))
    base = (every[1] + 1) / (every[0] + url_filter.LEAN)
    smooth = lambda x, up: (x[1] + url_filter.LEAN * up) / (x[0] + url_filter.LEAN)
    none = (0, 0)
    return [("/".join(names[h, s]), round(smooth(nodes.get((h, tuple(names[h, s])), none), smooth(hosts.get(h, none), base)), 6)) for h, s, _ in rows]


def test_url_tree_as_brute_force(spark):
    rng = random.Random(7)
    odds = {"spam": 0.9, "ads": 0.85, "news": 0.03, "blog": 0.05, "shop": 0.05}
    rows = []
    for _ in range(1500):
        host, first = rng.choice(["a.io", "b.io", "c.io"]), rng.choice([*odds])
        segments = (first, *[rng.choice(["x", "y"]) for _ in range(rng.randrange(2))], *([f"item{'abcdefghij'[rng.randrange(10)]}{'klmnopqrst'[rng.randrange(10)]}"] if rng.random() < 0.6 else []))
        rows.append((host, segments, None if host == "c.io" or rng.random() < 0.3 else int(rng.random() < odds[first])))
    rows.append(("lone.io", ("q", "r"), None))
    pages = spark.createDataFrame([(i, f"http://{h}/{'/'.join(s)}") for i, (h, s, _) in enumerate(rows)], "page_id long, url string")
    labels = spark.createDataFrame([(i, 1 - b, None) for i, (_, _, b) in enumerate(rows) if b is not None], "doc_id long, quality int, toxic int")
    got = {r.page_id: (r.template, r.bad_share, r.verdict) for r in url_filter.judge(pages, labels).collect()}
    want = brute_tree(rows)
    assert [got[i][:2] for i in range(len(rows))] == [(t, pytest.approx(p, abs=2e-6)) for t, p in want]
    blocked = {rows[i][1][0] for i in got if got[i][2] == "block"}
    assert blocked >= {"spam"} and not blocked & {"news", "blog"} and any("*" in t for t, _ in want)


def test_neighbours_against_brute_force(spark):
    rng = np.random.default_rng(5)
    x = rng.standard_normal((1500, 16)).astype("float32")
    x[700:760] = x[3]
    rows = [(i, [float(c) for c in v]) for i, v in enumerate(x)] + [(2000, None), (2020, [0.0] * 16), (2040, [float("nan")] + [1.0] * 15), (2060, [None] + [1.0] * 15), (2061, [])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got: dict = {}
    for r in neighbours.search(clash(df), block=400).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.vec_id, r.score))
    y = x.astype(float)
    assert set(got) == set(range(0, 1500, 20))
    hit = 0
    for q, found in got.items():
        s = y @ y[q]
        want = [int(i) for i in np.lexsort((np.arange(1500), -np.round(s, 9))) if i != q][:20]
        assert len(found) == 20 and all(abs(s[i] - v) < 1e-9 for i, v in found)
        hit += len(set(want) & {i for i, _ in found})
    assert hit >= 0.9 * 20 * len(got)
    assert neighbours.search(df.limit(0)).count() == 0
    assert neighbours.search(df.filter("vec_id < 3")).count() == 2


@pytest.mark.parametrize("hot, block, heavy, words", [(20_000, 1024, 16_000, 1 << 20), (20_000, 3, 4, 1 << 20), (2, 3, 16_000, 40), (2, 1024, 3, 40)])
def test_line_dedup_as_brute_force(spark, empty, monkeypatch, hot, block, heavy, words):
    for name, value in (("BLOCK", block), ("HEAVY", heavy), ("WORDS", words)):
        monkeypatch.setattr(line_dedup, name, value)
    random.seed(6)
    base = [" ".join(f"w{random.randint(0, 40)}" for _ in range(random.randint(1, 12))) for _ in range(30)]
    base += [" ".join(f"v{random.randint(0, 40)}" for _ in range(60))]
    rows = []
    for i in range(60):
        lines = []
        for _ in range(random.randint(0, 6)):
            w = random.choice(base).split(" ")
            for _ in range(random.randint(0, 2)):
                w[random.randrange(len(w))] = "New" + str(random.randint(0, 3))
            lines.append(" ".join(w))
        rows.append((i, "\n".join(lines)))
    docs = spark.createDataFrame([*rows, (70, None), (71, " \n\n")], "doc_id long, text string")
    lines = [(i, k, frozenset(line.lower().split())) for i, t in rows for k, line in enumerate(t.split("\n")) if line.split()]
    alike = lambda a, b: 100 * len(a & b) >= 75 * len(a | b)
    sets = {s for *_, s in lines}
    want = {i: [0, 0, 0] for i in [*range(60), 70, 71]}
    for i, k, s in lines:
        want[i][0] += 1
        want[i][1] += any((j, m) < (i, k) and alike(s, x) for j, m, x in lines)
        want[i][2] += sum(alike(s, x) for x in sets if x != s)
    if hot == 2:  # a small table has no word that frequent, so words count as hot from fewer lines on
        plain = line_dedup._prefixes
        monkeypatch.setattr(line_dedup, "_prefixes", lambda rarity: plain(np.where(rarity > 2, rarity + line_dedup.HOT, rarity)))
    assert {r.doc_id: [r.n_lines, r.n_removed, r.n_links] for r in line_dedup.line_dedup(clash(docs)).collect()} == want
    if hot == 2 or block == 3:
        return
    long = " ".join(f"l{i}" for i in range(3000))
    many = spark.createDataFrame([(i, f"{long} a{i}") for i in range(40)], "doc_id long, text string")
    assert [r.n_links for r in line_dedup.line_dedup(many).collect()] == [39] * 40
    assert line_dedup.line_dedup(empty).count() == 0
    left = {r.doc_id: r.text for r in line_dedup.cleaned(docs).collect()}
    assert all(len([x for x in left[i].split("\n") if x.split()]) == want[i][0] - want[i][1] for i in range(60))
    gone = {(i, k) for i, k, s in lines if any((j, m) < (i, k) and alike(s, x) for j, m, x in lines)}
    whole = {i: "\n".join(x for k, x in enumerate((t or "").split("\n")) if (i, k) not in gone) for i, t in [*rows, (70, None), (71, " \n\n")]}
    assert {i: t or "" for i, t in left.items()} == whole and left[70] is None
    assert {r.doc_id: r.text_sha256 for r in line_dedup.line_dedup(docs).collect()} == {i: hashlib.sha256(t.encode()).hexdigest() for i, t in whole.items()}


def test_bitmaps_of_lines_bound_their_difference():
    """Never more than the words in which two sets differ, whatever their widths, and by chance not much less."""
    rng = np.random.default_rng(11)
    pool = rng.integers(0, 1 << 63, 5000, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    n = rng.choice([1, 5, 56, 57, 112, 113, 224, 225, 300, 900], 60)
    sets = [set(pool[rng.choice(len(pool) if i % 2 else 1000, k, replace=False)].tolist()) for i, k in enumerate(n)]
    width, flat = line_dedup._bits(np.concatenate([np.array([*x], dtype=np.uint64) for x in sets]), n)
    assert {(int(k), int(w)) for k, w in zip(n, width, strict=True)} <= {(1, 1), (5, 1), (56, 1), (57, 2), (112, 2), (113, 4), (224, 4), (225, 8), (300, 8), (900, 8)}
    maps = line_dedup.Bitmaps.laid(width, flat)
    i, j = np.triu_indices(len(n), 1)
    true = np.array([len(sets[a] ^ sets[b]) for a, b in zip(i, j, strict=True)])
    apart, folded = maps.apart(i, j), np.bitwise_count(maps.folded[i] ^ maps.folded[j])
    assert (apart <= true).all() and (folded <= true).all()
    both = (width[i] > 1) & (width[j] > 1)
    assert (apart[~both] == 0).all() and (apart[both] >= folded[both]).all()
    assert (apart[(n[i] == 300) & (n[j] == 300)] > 150).all()
    some = np.flatnonzero(n > 100)
    assert (maps.only(some).apart(np.arange(len(some) - 1), np.arange(1, len(some))) == maps.apart(some[:-1], some[1:])).all()


def whole_pieces(rows, capacity):
    """(doc_id, piece, start, length, ids_crc32) by the library on whole texts."""
    lib, out = Tokenizer.from_file(WORDS), []
    for i, text in rows:
        ids = lib.encode(text or "", add_special_tokens=False).ids + [1]
        out += [(i, k, s, len(ids[s : s + capacity]), zlib.crc32(np.array(ids[s : s + capacity], dtype="<u4").tobytes())) for k, s in enumerate(range(0, len(ids), capacity))]
    return sorted(out, key=repr)


def check_packing(rows, capacity):
    spans: dict = {}
    for r in rows:
        spans.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for v in spans.values():
        at = 0
        for offset, length in sorted(v):
            assert offset == at
            at += length
        assert at <= capacity
    return len(spans)


SPECIAL = "a<|endoftext|>B <|startoftext|> <|EndOfText|> x <|endoftext|> it's IT'S 10% ÉÀß×÷ «é» e\u0301"


def test_packing(spark, docs, empty):
    more = docs.unionByName(spark.createDataFrame([(9, SPECIAL, "en", "s", 1), (9, SPECIAL, "en", "s", 1), (2**60, "x" * 50_000, "en", "s", 1)], DOCS))
    rows = packing.pack_documents(clash(more), WORDS, capacity=64).collect()
    texts = [(i, t) for i, t, *_ in ROWS] + [(9, SPECIAL)] * 2 + [(2**60, "x" * 50_000)]
    assert sorted(((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows), key=repr) == whole_pieces(texts, 64)
    check_packing(rows, 64)
    assert {(r.doc_id, r.length) for r in rows if r.doc_id in (3, 4, 7)} == {(3, 1), (4, 1), (7, 1)}
    assert packing.pack_documents(empty, WORDS).count() == 0


def test_packing_of_the_whole_table(spark):
    d = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = packing.pack_documents(d, WORDS).collect()
    assert sorted(((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows), key=repr) == whole_pieces([(r.doc_id, r.text) for r in d.collect()], 4096)
    assert check_packing(rows, 4096) <= 1.01 * sum(r.length for r in rows) / 4096 + 1


def test_best_fit_over_counts_as_over_documents():
    random.seed(12)
    for capacity in (16, 100):
        lengths = [random.choice([1, 2, 3, 5, 7, capacity // 2, capacity // 2 + 1, capacity]) for _ in range(400)]
        rooms: list = []
        for n in sorted(lengths, reverse=True):
            fit = min((r for r in rooms if r >= n), default=None)
            if fit is None:
                rooms.append(capacity - n)
            else:
                rooms.remove(fit)
                rooms.append(fit - n)
        used = {s + k for _, first, n, per, s, _ in packing.plan(Counter(lengths), capacity) for k in range(-(-n // per))}
        assert len(used) == len(rooms)


def test_tokens_as_the_library():
    lib, own = Tokenizer.from_file(WORDS), packing.WordTokenizer(WORDS)
    random.seed(7)
    parts = ["a", "The", "  ", "\n", " ", "é", "É", "ÿ", "×", "é", "日本", "😀", "12", "'s", "'LL", "...", "\x1c", "ΑΣ", "\t", "İ", "<|endoftext|>", "<|", "|>", "\x85", "\x7f", "\xa0", "µ", "²", "~"]
    texts = ["".join(random.choice(parts) for _ in range(random.randint(0, 14))) for _ in range(4000)]
    want = [e.ids for e in lib.encode_batch(texts, add_special_tokens=False)]
    for size in (5, 100_000):
        own.kept = packing.Kept(size)
        got = []
        for at in range(0, len(texts), 50):
            got += own.encode([t.encode() for t in texts[at : at + 50]])
        assert [np.frombuffer(x, dtype="<u4").tolist() for x in got] == want


def test_language_id_on_held_out_documents(spark, docs, empty):
    sf = "/root/testdata/sf0.01"
    all_docs = spark.read.parquet(f"{sf}/documents.parquet")
    train = all_docs.filter("doc_id % 2 = 0")
    test = all_docs.filter("doc_id % 2 = 1 AND n_chars > 200")
    pages = test.select(F.col("doc_id").alias("page_id"), F.lit("http://h.example.com/").alias("url"), F.concat(F.lit("<html><p>"), "text", F.lit("</p>")).alias("html"))
    got = language_id.identify_pages(pages, train).join(test.withColumnRenamed("lang", "true"), F.col("page_id") == F.col("doc_id"))
    right, n = got.select(F.count_if(F.col("lang") == F.col("true")), F.count("*")).first()
    assert right >= 0.95 * n
    kept = language_id.drop_unknown(clash(docs))
    assert kept.columns == clash(docs).columns and not {3, 4, 7} & {r.doc_id for r in kept.collect()}
    assert language_id.drop_unknown(empty).count() == 0
    assert language_id.drop_unknown(all_docs).count() >= 0.99 * all_docs.count()


def test_declared_language_behind_a_long_preamble(spark, docs):
    far = "<!--" + "x " * 40_000 + "-->\n<HTML class='" + "c " * 5000 + "' LANG='FR-ca'><p>le chat"
    htmls = [far, "<html><html lang=de><p>x", "<p lang=fr><html dir=ltr>lang=en", "<html lang=en", "<html" * 50_000, None]
    pages = spark.createDataFrame([(i, "http://h.com/", x) for i, x in enumerate(htmls)], "page_id long, url string, html string")
    assert {r.page_id: r.declared for r in language_id.identify_pages(pages, docs).collect()} == {0: "fr", 1: "de", 2: "", 3: "en", 4: "", 5: ""}


def test_rare_declarations_and_many_languages_count(spark):
    rows = [(i, f"d{i % 1200}", [1.0, 0.0]) for i in range(3600)] + [(4000, "z", [0.0, 1.0]), (4001, "z", [0.5, 0.5])]
    rows = spark.createDataFrame(rows, "key long, declared string, soft array<double>").withColumns({"letters": F.lit(9).cast("long"), "loglik": F.transform("soft", lambda x: F.log(x + 1e-9)), **{c: F.lit("") for c in ("suffix", "domain", "host")}})
    assert language_id.fuse(rows, ["a", "b"]).filter("key = 4001").first().lang == "b"
    docs = spark.createDataFrame([(70 * k + i, f"{chr(0x4E00 + 50 * i)}{chr(0x4E07 + 50 * i)}" * (40 + k), f"l{i:02}", "s", 1) for i in range(70) for k in range(2)], DOCS)
    assert language_id.learn(docs)[0] == [f"l{i:02}" for i in range(70)]
    assert language_id.drop_unknown(docs).count() == 140


def test_toxicity_on_held_out_documents(spark, docs, empty):
    sf = "/root/testdata/sf0.1"
    d, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    got = toxicity.score_documents(d, labels).join(labels, "doc_id").filter("held_out").select("score", "predicted", "toxic").toPandas()
    pos, neg = got[got.toxic == 1].score, got[got.toxic == 0].score
    auc = np.mean([(neg < s).mean() + 0.5 * (neg == s).mean() for s in pos])
    assert auc >= 0.95
    assert got[(got.toxic == 0)].predicted.mean() < 0.02
    none = labels.limit(0)
    assert [r.predicted for r in toxicity.score_documents(clash(docs), none).collect()] == [0] * len(ROWS)
    assert toxicity.score_documents(empty, labels).count() == 0
    assert toxicity.drop_toxic(clash(docs), none).columns == clash(docs).columns


def test_toxicity_folds_and_spares():
    lexicon = toxicity.Lexicon({"idiot": 3.0, "trash": 3.0}, toxicity.EXCEPTIONS, (-4.0, 2.0, 0.5))
    m = lexicon.matcher()
    hit = lambda t: lexicon.features(t, m)[0] > 0
    assert hit("an Idiot") and hit("an 1d10t") and hit("an іdiоt") and hit("IDIOTS!") and hit("ｉｄｉｏｔ")
    assert not hit("a trash can") and not hit("paidiot") and hit("trash canal") and not hit("")


@pytest.mark.parametrize("turn", [1, -1])
def test_near_dedup_of_repeated_ids_with_different_texts(spark, turn):
    """No link is lost and no text goes with another one of its id, whatever the order of the rows."""
    a, b, c = (" ".join(f"{x}{i}" for i in range(80)) for x in "abc")
    rows = [(1, a), (5, a + " more"), (5, b), (5, b + " more"), (7, c), (7, None), (8, c + " end"), (9, b + " other"), (9, b + " other"), (2, c + " the end")][::turn]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((r.doc_id, r.component_id, r.kept) for r in near_dedup.near_dedup(clash(docs)).collect())
    assert got == sorted([(1, 1, True), (5, 1, False), (5, 5, True), (5, 5, True), (7, 2, False), (7, 7, True), (8, 2, False), (9, 5, False), (9, 5, False), (2, 2, True)])
    kept = near_dedup.drop_near_copies(clash(docs))
    assert kept.columns == clash(docs).columns
    assert sorted(((r[0], r[1]) for r in kept.collect()), key=repr) == sorted([(1, a), (5, b), (5, b + " more"), (7, None), (2, c + " the end")], key=repr)


def test_long_keys_pass_by_in_parts():
    """Keys that go beyond one table come as they are, all others whole, whatever the batches."""
    rng = random.Random(12)
    keys = sorted([1] * 5 + [2] * 90 + [3] * 7 + [4] * 40 + [rng.randrange(5, 60) for _ in range(100)])
    for size in (1, 7, 1000):
        batches = [pa.RecordBatch.from_arrays([pa.array([k << 24 | 5 for k in keys[i : i + size]], pa.int64())], names=["key"]) for i in range(0, len(keys), size)]
        found = list(line_dedup._grouped(iter(batches), "key", 30, 24))
        assert [k >> 24 for t, _ in found for k in t.column("key").to_pylist()] == keys
        whole = [set(k >> 24 for k in t.column("key").to_pylist()) for t, more in found if not more]
        long = [set(k >> 24 for k in t.column("key").to_pylist()) for t, more in found if more]
        assert all(len(x) == 1 for x in long) and sum(map(len, whole)) == len(set().union(*whole)) and not set().union(*whole) & set().union(*long)


def test_time_grows_with_the_length_of_odd_pages_and_texts():
    import time

    start = time.time()
    for part in ("<script>", "<style ", "<!-- ", "< ", "<script></style>"):
        assert language_id.visible(part * 100_000 + " end").strip().endswith("end")
    lexicon = toxicity.Lexicon({"trash": 1.0}, ("trash can",))
    assert lexicon.features("trash can " * 100_000 + "trash", lexicon.matcher())[0] == pytest.approx(np.log1p(1.0))
    assert time.time() - start < 30
    assert language_id.visible("a<SCRIPT x>b<c</script >d<!-- e > -->f<g\nh>i &lt; <j") == "a d f i < <j"
    assert language_id.visible("<script>a<b>c</style>d<!--e") == " a c d<!--e"


def test_labels_and_vectors_that_repeat(spark):
    texts = spark.createDataFrame([(i, ("vile filth " if i % 2 else "fine words ") * 3) for i in range(200)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(200)] + [(i, 0) for i in range(200)], "doc_id long, toxic int")
    got = {r.doc_id: r.predicted for r in toxicity.score_documents(texts, labels).collect()}
    assert got == {i: i % 2 for i in range(200)}  # the worst of labels that disagree
    rows = [(0, [1.0, 0.0]), (20, [0.0, 1.0]), (20, [-1.0, 0.0]), (3, [1.0, 1.0])]
    for some in (rows, rows[::-1]):
        found = neighbours.search(spark.createDataFrame(some, "vec_id long, embedding array<double>")).collect()
        assert {(r.query_id, r.vec_id, r.score) for r in found} == {(0, 3, 1.0), (0, 20, -1.0), (20, 0, -1.0), (20, 3, -1.0)}
