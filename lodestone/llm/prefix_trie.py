"""The trie of conversations' prefixes: a node for each distinct sequence of first turns, with what hangs below it.

A conversation is a string of turns, each by the MD5 of its role and text. Strings are sorted and dealt in ranges,
equal ones once; each task puts those of its range, a batch at once, into a Z-fast trie. Its compacted nodes stand in a
hash table under their handles, the prefixes of their strings whose length is the two-fattest number between their parent's length
and their own (the one that most twos divide). Fat binary search finds the node at which a string leaves the trie in as
many look-ups as its length has bits; the string is hung there. What a later string of the sorted range
can't reach any more is expanded, a row for each turn of its edge, and leaves the task's memory after each batch.

Only prefixes of a range's first or last string can stand in other ranges as well. Their rows have what is known inside
the range; a shared prefix belongs to the first of the paths that has it, each path sums up its own nodes from its end, and one grouping
adds the paths. Nothing of the size of the data meets in one task: a task holds the turns' digests of a batch
and of its range's first string, and nodes along two paths.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import LARGE, marked_by, pick, written
from .words import mixed

#: A turn's digest, in bytes.
WIDTH = 16
NOTHING = hashlib.sha256(b"").hexdigest()
#: Conversations' numbers that one row of text holds, while the digest of a node's own is made.
CHUNK = 20_000
NODES = "digest binary, up binary, path long, depth long, conv_id long, parent_conv_id long, bytes long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string, early boolean"
COUNTED = ("n_convs", "n_children", "n_leaves", "saved_tokens")


def two_fattest(low: int, high: int) -> int:
    """The number in (low, high] that the highest power of two divides."""
    return high & -1 << (low ^ high).bit_length() - 1


class String:
    """A conversation: the digests of its prefixes (of 0, 1 ... turns), the bytes of their texts, its smallest member, how many there are, and their digest."""

    __slots__ = ("conv", "digests", "members", "sha", "size", "sums")

    def __init__(self, symbols: bytes, sizes: np.ndarray, conv: int, members: int, sha: str):
        turns = np.frombuffer(symbols, dtype="<u8").reshape(-1, 2)
        at = mixed(np.arange(1, len(turns) + 1, dtype=np.uint64))[:, None]
        sums = np.zeros((len(turns) + 1, 2), dtype="<u8")
        np.cumsum(mixed(turns ^ at), axis=0, out=sums[1:])
        whole = sums.tobytes()
        self.digests = [whole[i : i + WIDTH] for i in range(0, len(whole), WIDTH)]
        self.size, self.sums = len(turns), np.r_[0, np.cumsum(sizes)]
        self.conv, self.members, self.sha = conv, members, sha

    def shared(self, other: String, low: int, high: int) -> int:
        """The length of the longest common prefix, which is low to high."""
        while low < high:
            middle = (low + high + 1) // 2
            if self.digests[middle] == other.digests[middle]:
                low = middle
            else:
                high = middle - 1
        return low


class Node:
    """A compacted node: the first turns of a string, as many as its size; above it the edge from its parent.

    members, conv and sha tell of conversations that end here; gone of what hung below and has been expanded: children, leaves, savings, members, smallest member.
    """

    __slots__ = ("conv", "gone", "kids", "members", "sha", "size", "string", "up")

    def __init__(self, string: String, size: int, up: Node | None):
        self.string, self.size, self.up = string, size, up
        self.members, self.conv, self.sha, self.gone = 0, None, None, [0, 0, 0, 0, None]
        self.kids: dict[bytes, Node] = {}

    @property
    def handle(self) -> tuple[int, bytes]:
        at = two_fattest(self.up.size, self.size)
        return at, self.string.digests[at]

    @property
    def branch(self) -> bytes:
        """The prefix that tells it from its parent's other children."""
        return self.string.digests[self.up.size + 1]


def least(*numbers: int | None) -> int | None:
    return min((x for x in numbers if x is not None), default=None)


class ZFastTrie:
    """A trie of strings that are inserted in batches; the root is the empty string."""

    def __init__(self, first: String):
        self.root = Node(first, 0, None)
        self.handles: dict[tuple[int, bytes], Node] = {}

    def above_exit(self, string: String) -> Node:
        """The deepest node that is a prefix of a string, by fat binary search over the lengths of handles."""
        found, low, high = self.root, 0, string.size
        while low < high:
            at = two_fattest(low, high)
            node = self.handles.get((at, string.digests[at]))
            if node is not None and node.size <= string.size and node.string.digests[node.size] == string.digests[node.size]:
                found, low = node, node.size
            else:
                high = at - 1
        return found

    def _hang(self, node: Node) -> None:
        node.up.kids[node.branch] = node
        self.handles[node.handle] = node

    def insert(self, strings: list[String]) -> None:
        """A batch of distinct strings."""
        for string in strings:
            at = self.above_exit(string)
            below = at.kids.get(string.digests[at.size + 1]) if at.size < string.size else None
            if below is not None:  # it leaves within that edge, which is divided there
                del self.handles[below.handle]
                at = Node(below.string, string.shared(below.string, at.size + 1, min(string.size, below.size)), at)
                self._hang(at)
                below.up = at
                self._hang(below)
            if at.size < string.size:
                at = Node(string, string.size, at)
                self._hang(at)
            at.members, at.conv, at.sha = string.members, string.conv, string.sha

    def drop(self, node: Node) -> None:
        del self.handles[node.handle]
        del node.up.kids[node.branch]

    def path(self, string: String) -> list[Node]:
        """The nodes that are prefixes of a string, from the root on."""
        out = [self.root]
        while out[-1].size < string.size:
            kid = out[-1].kids.get(string.digests[out[-1].size + 1])
            if kid is None or kid.size > string.size:
                break
            out.append(kid)
        return out


class Range:
    """The trie of one task's range of sorted strings, and rows of NODES for what has been expanded."""

    def __init__(self, number: int, first: String):
        self.number, self.first, self.trie = number, first, ZFastTrie(first)
        self.rows: list[tuple] = []

    def _expand(self, top: Node) -> None:
        """Rows of all nodes below and on the edge of one that no path goes through, whose parent keeps the sums."""
        order, todo = [], [top]
        while todo:
            node = todo.pop()
            order.append(node)
            todo += node.kids.values()
        convs, early = {}, {id(n) for n in order if n.gone[0]}  # those that have lost children to earlier batches
        for node in reversed(order):
            children, leaves, saved, members, conv = node.gone
            members, conv, string = members + node.members, least(conv, node.conv), node.string
            leaves = leaves or 1
            convs[id(node)] = conv
            low = node.up.size
            for depth in range(node.size, low, -1):
                size = int(string.sums[depth] - string.sums[depth - 1])
                saved += (members - 1) * size
                last = depth == node.size
                # the parent of an edge's first turn is known when its own node is; that of children that went early isn't yet
                self.rows.append([string.digests[depth], string.digests[depth - 1], None, depth, conv, conv if depth > low + 1 else None, size, members, children if last else 1, leaves, saved, node.sha if last else None, last and id(node) in early])
            above = node.up.gone
            above[:] = above[0] + 1, above[1] + leaves, above[2] + saved, above[3] + members, least(above[4], conv)
            node.gone = [len(self.rows) - 1]  # where its first turn's row is
        for node in order[1:]:
            self.rows[node.gone[0]][5] = convs[id(node.up)]
        for node in order[1:]:
            del self.trie.handles[node.handle]
        self.trie.drop(top)

    def finish(self, last: String) -> None:
        """Expands all that hangs off the paths of the first string and of the last one so far."""
        paths = [self.trie.path(s) for s in (self.first, last)]
        stay = {id(n) for p in paths for n in p}
        for path, string in zip(paths, (self.first, last), strict=True):
            for node in path:
                node.string = string  # no other one need be kept
                for kid in [k for k in node.kids.values() if id(k) not in stay]:
                    self._expand(kid)

    def paths(self, last: String) -> None:
        """Rows of the prefixes of the first string and of the last one, each with what hangs off it in this range."""
        paths = [self.trie.path(s) for s in (self.first, last)]
        whole, sums = {}, {}
        for node in sorted({id(n): n for p in paths for n in p}.values(), key=lambda n: -n.size):
            members, conv = node.gone[3] + node.members, least(node.gone[4], node.conv)
            for k in node.kids.values():
                members, conv = members + sums[id(k)][0], least(conv, sums[id(k)][1])
            sums[id(node)] = members, conv
        for side, (path, string) in enumerate(zip(paths, (self.first, last), strict=True)):
            for node in path:
                new = id(node) not in whole
                whole[id(node)] = True
                members, conv = sums[id(node)] if new else (0, None)
                for depth in range(node.size, node.up.size if node.up else -1, -1):
                    size = int(string.sums[depth] - string.sums[depth - 1]) if depth else 0
                    children, leaves, saved = node.gone[:3] if new and depth == node.size else (0, 0, 0)
                    up = string.digests[depth - 1] if depth else None
                    self.rows.append([string.digests[depth], up, 2 * self.number + side, depth, conv, None, size, members, children, leaves, saved, node.sha if depth == node.size else None, False])

    def batch(self) -> pa.RecordBatch:
        kinds = [{"long": pa.int64(), "binary": pa.binary(), "string": pa.string(), "boolean": pa.bool_()}[x.split()[1]] for x in NODES.split(", ")]
        columns = zip(*self.rows, strict=True) if self.rows else [()] * len(kinds)
        self.rows = []
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=[x.split()[0] for x in NODES.split(", ")])


def _nodes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of NODES of a range's sorted, distinct strings (symbols, sizes, conv_id, members, sha)."""
    here, last = None, None
    for batch in batches:
        if not batch.num_rows:
            continue
        symbols, conv, members, sha = (batch.column(c).to_pylist() for c in ("symbols", "conv_id", "members", "sha"))
        sizes = batch.column("sizes")
        ends, flat = sizes.offsets.to_numpy(), sizes.values.to_numpy()
        strings = [String(x, flat[a:b], *more) for x, a, b, *more in zip(symbols, ends[:-1], ends[1:], conv, members, sha, strict=True)]
        here, last = here or Range(TaskContext.get().partitionId(), strings[0]), strings[-1]
        here.trie.insert(strings)
        here.finish(last)
        yield here.batch()
    if here is not None:
        here.paths(last)
        yield here.batch()


def strings(conversations: DataFrame) -> DataFrame:
    """(conv_id, turns array<struct<symbol, size>>) of each conversation: its turns' digests and the bytes of their texts.

    Turns stand by number (null first), those of one number by role, then text. Null roles and texts are empty; rows
    without a conv_id are left out. A conversation's digests (not its texts) make one row; only texts whose order isn't
    told by number and role are sorted.
    """
    rows = pick(conversations, conv_id="long", turn="long", role="string", text="string").filter("conv_id IS NOT NULL").fillna("", ["role", "text"])
    rows = rows.withColumn("symbol", F.md5(F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text"))).withColumn("size", F.octet_length("text").cast("long"))
    key = F.xxhash64("conv_id", "turn", "role")
    ties = rows.groupBy("conv_id", "turn", "role").agg((F.min("symbol") < F.max("symbol")).alias("tied")).filter("tied").select(key.alias("id"))
    met = marked_by(rows, key, written(ties, "ties"))  # a text too many changes no order
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "_text")
    put = met.select("conv_id", "turn", "role", "symbol", "size", F.when(F.col("_may"), F.col("text")).alias("_text")).withColumn("place", F.row_number().over(order))
    turns = F.sort_array(F.collect_list(F.struct("place", "symbol", "size")))
    return put.groupBy("conv_id").agg(turns.alias("turns")).select("conv_id", F.transform("turns", lambda t: F.struct(t["symbol"].alias("symbol"), t["size"].alias("size"))).alias("turns"))


def rebuilt(found: DataFrame, every: int = 5, most: int = 9) -> DataFrame:
    """The strings of conversations that begin with turns of another one: h = crc32(conv_id) % most turns of conversation
    conv_id - conv_id % every (all if it has fewer, none if there is none), then their own after their first h."""
    found = written(found, "strings")
    heads = found.filter(F.col("conv_id") % every == 0).select(F.col("conv_id").alias("base"), F.slice("turns", 1, most - 1).alias("head"))
    h = (F.crc32(F.col("conv_id").cast("string")) % most).cast("int")
    both = found.withColumn("h", h).join(heads, F.col("conv_id") - F.col("conv_id") % every == F.col("base"), "left")
    own = F.slice("turns", F.col("h") + 1, F.greatest(F.size("turns") - F.col("h"), F.lit(0)))
    head = F.coalesce(F.slice("head", F.lit(1), F.col("h")), F.array().cast("array<struct<symbol:string,size:bigint>>"))
    return both.select("conv_id", F.concat(head, own).alias("turns"))


def _texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(whole, conv_id, members, text): numbers that follow each other in one group, as text, with the first of them."""
    for batch in batches:
        whole, conv = batch.column("whole").to_pylist(), batch.column("conv_id").to_pylist()
        cuts = [0, *(i for i in range(1, len(whole)) if whole[i] != whole[i - 1] or i % CHUNK == 0), len(whole)] if whole else [0]
        rows = [(whole[a], conv[a], b - a, ",".join(map(str, conv[a:b]))) for a, b in zip(cuts, cuts[1:], strict=False)]
        columns = zip(*rows, strict=True) if rows else [()] * 4
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, (pa.binary(), pa.int64(), pa.int64(), pa.string()), strict=True)], names=["whole", "conv_id", "members", "text"])


def _digested(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(conv_id, members, sha) of each group of texts, which come by group and first number."""

    def told(done: list[tuple]) -> pa.RecordBatch:
        columns = zip(*done, strict=True) if done else [()] * 3
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, (pa.int64(), pa.int64(), pa.string()), strict=True)], names=["conv_id", "members", "sha"])

    group, conv, members, h = None, None, 0, None
    for batch in batches:
        done = []
        for whole, first, n, text in zip(*(batch.column(c).to_pylist() for c in ("whole", "conv_id", "members", "text")), strict=True):
            if whole != group:
                if group is not None:
                    done.append((conv, members, h.hexdigest()))
                group, conv, members, h = whole, first, 0, hashlib.sha256()
            h.update((("," if members else "") + text).encode())
            members += n
        yield told(done)
    yield told([(conv, members, h.hexdigest())] if group is not None else [])


def distinct(found: DataFrame) -> DataFrame:
    """(symbols, sizes, conv_id, members, sha) of each distinct string: its smallest conversation, how many there are, and the digest of their numbers.

    Groups of copies meet as ordered numbers only, written out in parts by all tasks; one task hashes the text of a group as it streams by.
    """
    symbols = F.unhex(F.array_join(F.transform("turns", lambda t: t["symbol"]), ""))
    rows = found.select("conv_id", symbols.alias("symbols"), F.transform("turns", lambda t: t["size"]).alias("sizes"))
    rows = written(rows, "rebuilt")
    whole = rows.select(F.unhex(F.md5("symbols")).alias("whole"), "conv_id")
    texts = whole.repartitionByRange("whole", "conv_id").sortWithinPartitions("whole", "conv_id").mapInArrow(_texts, "whole binary, conv_id long, members long, text string")
    groups = texts.repartition("whole").sortWithinPartitions("whole", "conv_id").mapInArrow(_digested, "conv_id long, members long, sha string")
    return rows.join(groups.withColumnRenamed("conv_id", "_id"), F.col("conv_id") == F.col("_id")).select("symbols", "sizes", "conv_id", "members", "sha")


def nodes(found: DataFrame) -> DataFrame:
    """(conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256) of each node of the trie of strings().

    conv_id is the smallest member; saved_tokens sums (n_convs - 1) times the bytes of the last text over the subtree;
    ends_sha256 is the digest of the numbers of the conversations that end at the node, joined by commas. Without
    conversations there are no nodes; conversations without turns are members of the root only.
    """
    dealt = distinct(found).repartitionByRange("symbols").sortWithinPartitions("symbols")
    rows = written(dealt.mapInArrow(_nodes, NODES), "trie-nodes")
    inside, paths = rows.filter("path IS NULL"), rows.filter("path IS NOT NULL")
    sums = [F.sum(c).alias(c) for c in ("n_convs", "n_children")]
    shared = paths.groupBy("digest", "depth").agg(F.first("up", ignorenulls=True).alias("up"), F.min("path").alias("owner"), F.max("bytes").alias("bytes"), F.min("conv_id").alias("conv_id"), *sums, F.max("ends_sha256").alias("ends_sha256"))
    shared = written(shared, "trie-paths", LARGE)
    kids = shared.filter("up IS NOT NULL").groupBy(F.col("up").alias("_up")).agg(F.count("*").alias("kids"))
    shared = shared.join(kids, F.col("digest") == F.col("_up"), "left").withColumn("n_children", F.col("n_children") + F.coalesce("kids", F.lit(0)))
    # each path sums up what hangs off it and the nodes that it owns, from its end on
    own = shared.select("digest", "owner", (F.col("n_children") == 0).cast("long").alias("leaf"), ((F.col("n_convs") - 1) * F.col("bytes")).alias("save"))
    mine = F.col("path") == F.col("owner")
    along = Window.partitionBy("path").orderBy(F.desc("depth")).rowsBetween(Window.unboundedPreceding, 0)
    summed = paths.select("path", "depth", "digest", "n_leaves", "saved_tokens").join(own, "digest")
    summed = summed.select("digest", *(F.sum(F.col(c) + F.when(mine, F.col(k)).otherwise(0)).over(along).alias(c) for c, k in (("n_leaves", "leaf"), ("saved_tokens", "save"))))
    summed = summed.groupBy(F.col("digest").alias("_digest")).agg(F.sum("n_leaves").alias("n_leaves"), F.sum("saved_tokens").alias("saved_tokens"))
    # the parents of what was expanded first: on a path still, or expanded by a later batch
    above = shared.select("digest", "conv_id").unionByName(inside.filter("early").select("digest", "conv_id")).toDF("_above", "_conv")
    on_path = shared.join(summed, F.col("digest") == F.col("_digest"))
    wanted = ("conv_id", "depth", "parent_conv_id", *COUNTED)
    last = F.coalesce("ends_sha256", F.lit(NOTHING)).alias("ends_sha256")
    tops = lambda df: df.join(above, F.col("up") == F.col("_above"), "left").withColumn("parent_conv_id", F.col("_conv"))
    out = inside.filter("parent_conv_id IS NOT NULL").select(*wanted, last)
    return out.unionByName(tops(inside.filter("parent_conv_id IS NULL")).select(*wanted, last)).unionByName(tops(on_path).select(*wanted, last))


def prefix_nodes(conversations: DataFrame) -> DataFrame:
    """nodes() of conversations as they are."""
    return nodes(strings(conversations))


def rebuilt_nodes(conversations: DataFrame) -> DataFrame:
    """nodes() of rebuilt() conversations."""
    return nodes(rebuilt(strings(conversations)))


_CRC = "xor(list_reduce([CAST(4294967295 AS BIGINT)] || list_transform(string_split(CAST(conv_id AS VARCHAR), ''), lambda ch: CAST(ascii(ch) AS BIGINT)), lambda c, x: xor(c >> 8, t[(xor(c, x) & 255) + 1])), CAST(4294967295 AS BIGINT))"
#: The nodes of rebuilt conversations from all their prefixes, for a check by SQL: each node counts for the prefixes of its smallest member.
SQL = f"""WITH crc AS (SELECT list_transform(range(256), lambda n: list_reduce([CAST(n AS BIGINT)] || range(8), lambda c, i: CASE WHEN c & 1 = 1 THEN xor(c >> 1, CAST(3988292384 AS BIGINT)) ELSE c >> 1 END)) AS t),
turns AS (SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS r FROM conversations WHERE conv_id IS NOT NULL),
convs AS (SELECT conv_id, conv_id - conv_id % 5 AS base, {_CRC} % 9 AS h, n FROM (SELECT conv_id, count(*) AS n FROM turns GROUP BY 1), crc),
heads AS (SELECT c.conv_id, r AS pos, role, text FROM convs c JOIN turns b ON b.conv_id = c.base AND b.r <= c.h),
sizes AS (SELECT c.conv_id, h, coalesce(least(h, b.n), 0) AS k FROM convs c LEFT JOIN (SELECT conv_id AS base, n FROM convs) b USING (base)),
own AS (SELECT t.conv_id, k + r - h AS pos, role, text FROM turns t JOIN sizes USING (conv_id) WHERE r > h),
rebuilt AS (SELECT conv_id, pos, strlen(text) AS bytes, md5(length(role) || ':' || role || text) AS symbol FROM (SELECT * FROM heads UNION ALL SELECT * FROM own)),
prefixes AS (SELECT conv_id, pos AS depth, bytes, string_agg(symbol, '') OVER (PARTITION BY conv_id ORDER BY pos) AS key, left(string_agg(symbol, '') OVER (PARTITION BY conv_id ORDER BY pos), CAST(32 * (pos - 1) AS BIGINT)) AS up FROM rebuilt UNION ALL SELECT conv_id, 0, 0, '', NULL FROM convs),
nodes AS (SELECT key, any_value(up) AS up, any_value(depth) AS depth, any_value(bytes) AS bytes, min(conv_id) AS conv_id, count(*) AS n_convs FROM prefixes GROUP BY 1),
kids AS (SELECT up AS key, count(*) AS n_children FROM nodes WHERE up IS NOT NULL GROUP BY 1),
whole AS (SELECT n.*, coalesce(n_children, 0) AS n_children FROM nodes n LEFT JOIN kids USING (key)),
sums AS (SELECT p.key, sum(CASE WHEN n_children = 0 THEN 1 ELSE 0 END) AS n_leaves, sum((n_convs - 1) * w.bytes) AS saved FROM whole w JOIN prefixes p ON p.conv_id = w.conv_id AND p.depth <= w.depth GROUP BY 1),
ends AS (SELECT key, sha256(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id)) AS sha FROM (SELECT conv_id, arg_max(key, depth) AS key FROM prefixes GROUP BY 1) GROUP BY 1)
SELECT w.conv_id, w.depth, u.conv_id AS parent_conv_id, w.n_convs, w.n_children, CAST(n_leaves AS BIGINT) AS n_leaves, CAST(saved AS BIGINT) AS saved_tokens, coalesce(sha, '{NOTHING}') AS ends_sha256
FROM whole w JOIN sums USING (key) LEFT JOIN ends USING (key) LEFT JOIN nodes u ON u.key = w.up"""
