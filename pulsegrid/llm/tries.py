"""The prefix trie of conversations: which turns they share, and what sharing them saves.

A turn becomes an id of 16 bytes, so a conversation is a byte string whose turn boundaries are multiples of 16. Distinct
strings are sorted by ranges, and each task puts runs of them into adaptive radix trees. A subtree that lies inside a run is
whole there. What runs may share are only the prefixes of a run's first and last string: these nodes are left open, added up
over runs, and closed at last; they are a few for each run, whatever the conversations are like.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pulsegrid.llm.common import materialise, read
from pulsegrid.llm.spelling import CRC_TABLE, crc32_sql

#: Bytes of a turn's id.
WIDTH = 16
#: A tree holds at most so many strings, or so many bytes of them, or one string.
RUN_ROWS, RUN_BYTES = 20_000, 8 << 20
#: Ids of a conversation's copies are joined for each range of so many ids, so that no list of all is ever held.
ID_RANGE = 4096
_NONE = hashlib.sha256(b"").hexdigest()


class Node:
    """A node of an adaptive radix tree: the bytes that its whole subtree shares beyond its parent's, the children by their next
    byte, and the number of the string that ends here.

    Up to 4 and 16 children are two sorted lists; up to 48, a table of 256 bytes has their places; beyond, children stand by their byte.
    """

    __slots__ = ("path", "end", "size", "keys", "places", "children")

    def __init__(self, path: bytes, end: int | None = None):
        self.path, self.end, self.size = path, end, 4
        self.keys: bytearray | None = bytearray()
        self.places: bytearray | None = None
        self.children: list = []

    def child(self, byte: int) -> Node | None:
        if self.size == 256:
            return self.children[byte]
        if self.size == 48:
            return self.children[self.places[byte] - 1] if self.places[byte] else None
        at = bisect_left(self.keys, byte)
        return self.children[at] if at < len(self.keys) and self.keys[at] == byte else None

    def put(self, byte: int, node: Node) -> None:
        """Sets the child of a byte, in a larger layout where this one is full."""
        if self.size == 256:
            self.children[byte] = node
        elif self.size == 48:
            if self.places[byte]:
                self.children[self.places[byte] - 1] = node
            elif len(self.children) < 48:
                self.children.append(node)
                self.places[byte] = len(self.children)
            else:
                self.children = [self.children[p - 1] if p else None for p in self.places]
                self.places, self.size = None, 256
                self.children[byte] = node
        else:
            at = bisect_left(self.keys, byte)
            if at < len(self.keys) and self.keys[at] == byte:
                self.children[at] = node
            elif len(self.keys) < self.size:
                self.keys.insert(at, byte)
                self.children.insert(at, node)
            elif self.size == 4:
                self.size = 16
                self.put(byte, node)
            else:
                self.places = bytearray(256)
                for place, key in enumerate(self.keys, 1):
                    self.places[key] = place
                self.keys, self.size = None, 48
                self.put(byte, node)

    def ordered(self) -> list[Node]:
        """The children by rising byte."""
        if self.size == 48:
            return [self.children[p - 1] for p in self.places if p]
        return [c for c in self.children if c is not None] if self.size == 256 else list(self.children)


def shared(a: bytes, b: bytes) -> int:
    """How many bytes a and b have in common at their start."""
    n = min(len(a), len(b))
    if a[:n] == b[:n]:
        return n
    low, high = 0, n
    while high - low > 1:
        mid = (low + high) // 2
        if a[low:mid] == b[low:mid]:
            low = mid
        else:
            high = mid
    return low


def insert(root: Node, key: bytes, number: int) -> None:
    """Puts a string into the tree; a path is split where the string leaves it."""
    node, at = root, 0
    while True:
        same = shared(node.path, key[at : at + len(node.path)])
        if same < len(node.path):
            rest = Node(node.path[same + 1 :], node.end)
            rest.size, rest.keys, rest.places, rest.children = node.size, node.keys, node.places, node.children
            byte = node.path[same]
            node.path, node.end, node.size, node.keys, node.places, node.children = node.path[:same], None, 4, bytearray(), None, []
            node.put(byte, rest)
        at += same
        if at == len(key):
            node.end = number
            return
        below = node.child(key[at])
        if below is None:
            node.put(key[at], Node(key[at + 1 :], number))
            return
        node, at = below, at + 1


_COLUMNS = {"run": "long", "open_id": "binary", "parent_open": "binary", "conv_id": "long", "parent_conv_id": "long", "depth": "long", "words": "long", "n_convs": "long", "n_children": "long", "n_leaves": "long", "saved_tokens": "long", "ends_sha256": "string"}
_TYPES = {"long": pa.int64(), "binary": pa.binary(), "string": pa.string()}
_ARROW = pa.schema([(c, _TYPES[t]) for c, t in _COLUMNS.items()])
_SPARK = ", ".join(f"{c} {t}" for c, t in _COLUMNS.items())


def _prefix_ids(key: bytes) -> list[bytes]:
    """An id of each turn-aligned prefix of a string, the empty one first."""
    out = [b"\0" * 16]
    for at in range(0, len(key), WIDTH):
        out.append(hashlib.md5(out[-1] + key[at : at + WIDTH]).digest())
    return out


class _Sum:
    """What a node of the radix tree knows of its subtree: members, and the closed trie nodes next below it, with their sums."""

    __slots__ = ("n", "least", "some", "kids", "leaves", "saved", "waiting")

    def __init__(self):
        self.n, self.least, self.some, self.kids, self.leaves, self.saved, self.waiting = 0, None, 0, 0, 0, 0, []

    def add(self, n: int, least: int, some: int) -> None:
        self.n += n
        self.least = least if self.least is None else min(self.least, least)
        self.some = some

    def take(self, other: _Sum) -> None:
        self.add(other.n, other.least, other.some)
        self.kids += other.kids
        self.leaves += other.leaves
        self.saved += other.saved
        self.waiting += other.waiting


def trie_rows(run: int, keys: list[bytes], words: list, n: list[int], least: list[int], ends: list[str]) -> dict[str, list]:
    """The trie nodes of distinct strings sorted in rising order; columns as in _COLUMNS.

    A node that is a prefix of the first or last string is open: it has an open_id and, in n_children, n_leaves and saved_tokens, only
    what its closed children bring. Others are closed: whole, with the parent's conv_id, or its open_id where it is open.
    """
    root = Node(b"")
    for number, key in enumerate(keys):
        insert(root, key, number)
    first, last = _prefix_ids(keys[0]), _prefix_ids(keys[-1])
    out: dict[str, list] = {c: [] for c in _COLUMNS}

    def emit(s: _Sum, depth: int, ended: int | None, opened: list[bytes] | None) -> None:
        """The trie node at a depth over all that s has; s then stands for what the level above sees."""
        own = words[s.some][depth - 1] if depth else 0
        row = len(out["run"])
        for at in s.waiting:
            out["parent_open" if opened else "parent_conv_id"][at] = opened[depth] if opened else s.least
        parent = opened[depth - 1] if opened and depth else None
        saved = s.saved + (0 if opened else (s.n - 1) * own)
        leaves = s.leaves if opened or s.kids else 1
        sha = ends[ended] if ended is not None else None if opened else _NONE
        for c, v in zip(out, (run, opened[depth] if opened else None, parent, s.least, None, depth, own, s.n, s.kids, leaves, saved, sha), strict=True):
            out[c].append(v)
        if opened:
            s.kids = s.leaves = s.saved = 0
            s.waiting = []
        else:
            s.kids, s.leaves, s.saved, s.waiting = 1, leaves, saved, [row]

    # (node, bytes above its path, on the first string's way, on the last one's); a node comes twice, the second time with its sum
    stack: list = [(root, 0, True, True, None)]
    done: list[_Sum] = []
    while stack:
        node, above, is_first, is_last, count = stack.pop()
        end = above + len(node.path)
        if count is None:
            children = node.ordered()
            stack.append((node, above, is_first, is_last, len(children)))
            for i, c in enumerate(children):
                stack.append((c, end + 1, is_first and node.end is None and i == 0, is_last and i == len(children) - 1, None))
            continue
        s = _Sum()
        if node.end is not None:
            s.add(n[node.end], least[node.end], node.end)
        for _ in range(count):
            s.take(done.pop())
        opened = first if is_first else last if is_last else None
        # the trie nodes on the way from the parent's end (above - 1, or the start) to here, the deepest first
        start = above - 1 if node is not root else -1
        for depth in range(end // WIDTH, start // WIDTH, -1):
            emit(s, depth, node.end if depth * WIDTH == end else None, opened)
        done.append(s)
    return out


def _build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Over rows (key, words, n, conv_id, ends) sorted by key: the rows of trie_rows, a tree for each run."""
    task, runs, held, size = TaskContext.get().partitionId(), 0, [], 0

    def flush() -> pa.RecordBatch:
        columns = [list(c) for c in zip(*held, strict=True)]
        rows = trie_rows((task << 32) | runs, *columns)
        return pa.RecordBatch.from_arrays([pa.array(rows[c], _ARROW.field(c).type) for c in _COLUMNS], schema=_ARROW)

    for batch in batches:
        for row in zip(*(batch.column(c).to_pylist() for c in ("key", "words", "n", "conv_id", "ends")), strict=True):
            held.append(row)
            size += len(row[0])
            if len(held) >= RUN_ROWS or size >= RUN_BYTES:
                yield flush()
                held, size, runs = [], 0, runs + 1
    if held:
        yield flush()


def _one_row_each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Over rows (sid, part, ids, n, conv_id, key, words) sorted by (sid, part): a row for each sid, with the SHA-256 of its ids. Only
    the hash's state is held while the parts pass."""
    schema = pa.schema([("key", pa.binary()), ("words", pa.list_(pa.int64())), ("n", pa.int64()), ("conv_id", pa.int64()), ("ends", pa.string())])
    now, sha, row = None, None, None
    for batch in batches:
        out = []
        for sid, ids, n, least, key, words in zip(*(batch.column(c).to_pylist() for c in ("sid", "ids", "n", "conv_id", "key", "words")), strict=True):
            if sid == now:
                sha.update(b"," + ids.encode())
                row[2] += n
                row[3] = min(row[3], least)
                continue
            if row:
                out.append([*row, sha.hexdigest()])
            now, sha, row = sid, hashlib.sha256(ids.encode()), [key, words, n, least]
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), schema, strict=True)], schema=schema)
    if row:
        yield pa.RecordBatch.from_arrays([pa.array([c], f.type) for c, f in zip([*row, sha.hexdigest()], schema, strict=True)], schema=schema)


def turns_of(conversations: DataFrame) -> DataFrame:
    """(conv_id, turns array<struct<turn, id, words>>) of conversations (conv_id, turn, role, text), a row for each conv_id.

    Turns are in the order of turn (null first), those of equal numbers in the order of their ids. A turn's id is the md5 of its role and
    text, null being empty; words are counted between blanks. Rows without a conv_id are left out. The turns of one conversation, not their texts, meet in one task.
    """
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    turn = F.struct("turn", F.md5(F.concat(F.char_length(role).cast("string"), F.lit(":"), role, text)).alias("id"), F.regexp_count(text, F.lit("[^\\x20\\x09-\\x0D]+")).cast("bigint").alias("words"))
    rows = conversations.where("conv_id IS NOT NULL").select(F.col("conv_id").cast("bigint").alias("conv_id"), turn.alias("t"))
    return rows.groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("turns"))


def sequences(convs: DataFrame) -> DataFrame:
    """(key, words, n, conv_id, ends) of convs (conv_id, turns): a row for each distinct sequence of turns, with the conversations that are it:
    how many, the smallest, and the SHA-256 of their ids, rising, joined by commas. Many copies are put together in parts, never in one list."""
    key = F.unhex(F.array_join(F.transform("turns", lambda t: t["id"]), ""))
    rows = convs.select("conv_id", key.alias("key"), F.transform("turns", lambda t: t["words"]).alias("words"))
    rows = rows.withColumn("sid", F.md5("key")).withColumn("part", F.floor(F.col("conv_id") / ID_RANGE))
    ids = F.array_join(F.transform(F.sort_array(F.collect_list("conv_id")), lambda i: i.cast("string")), ",")
    parts = rows.groupBy("sid", "part").agg(ids.alias("ids"), F.count(F.lit(1)).alias("n"), F.min("conv_id").alias("conv_id"), F.first("key").alias("key"), F.first("words").alias("words"))
    parts = parts.repartition("sid").sortWithinPartitions("sid", "part")
    return parts.mapInArrow(_one_row_each, "key binary, words array<bigint>, n bigint, conv_id bigint, ends string")


def _closed(parts: pd.DataFrame) -> pd.DataFrame:
    """The open nodes, added up over runs, with what the open nodes below them bring: level by level, from the deepest."""
    d = parts.reset_index(drop=True)
    place = pd.Series(d.index.to_numpy(), index=d["open_id"])
    parent = place.reindex(d["parent_open"]).to_numpy(dtype=float, na_value=-1).astype(np.int64)
    kids, leaves, saved = (d[c].to_numpy(np.int64).copy() for c in ("n_children", "n_leaves", "saved_tokens"))
    saved += (d["n_convs"].to_numpy(np.int64) - 1) * d["words"].to_numpy(np.int64)
    depth = d["depth"].to_numpy()
    np.add.at(kids, parent[parent >= 0], 1)
    leaves[kids == 0] = 1
    order = np.argsort(-depth, kind="stable")
    for level in np.split(order, np.flatnonzero(np.diff(depth[order])) + 1):
        at = level[parent[level] >= 0]
        np.add.at(leaves, parent[at], leaves[at])
        np.add.at(saved, parent[at], saved[at])
    d["n_children"], d["n_leaves"], d["saved_tokens"] = kids, leaves, saved
    d["parent_conv_id"] = pd.array(np.where(parent >= 0, d["conv_id"].to_numpy()[parent], 0), "Int64")
    d.loc[parent < 0, "parent_conv_id"] = pd.NA
    d["ends_sha256"] = d["ends_sha256"].fillna(_NONE)
    return d


def prefix_trie(convs: DataFrame) -> DataFrame:
    """(conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256) of convs (conv_id, turns): a row for each
    distinct sequence of first turns, the textless root included.

    convs are distinct in conv_id and may have no turns. An empty table gives no rows, not even a root. What meets in one task are sums of
    the open nodes: twice the turns of a conversation for each tree of up to 20,000 strings.
    """
    whole = materialise(sequences(convs), "sequences")
    rows = materialise(whole.repartitionByRange("key").sortWithinPartitions("key").mapInArrow(_build, _SPARK), "trie")
    names = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    opened = rows.where("open_id IS NOT NULL")
    total = lambda c: F.sum(c).alias(c)
    sums = opened.groupBy("open_id").agg(F.first("parent_open").alias("parent_open"), F.min("conv_id").alias("conv_id"), F.first("depth").alias("depth"), F.first("words").alias("words"), total("n_convs"), total("n_children"), total("n_leaves"), total("saved_tokens"), F.max("ends_sha256").alias("ends_sha256"))
    fields = "open_id binary, parent_open binary, conv_id long, depth long, words long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string, parent_conv_id long"
    closed = materialise(sums.withColumn("_one", F.lit(0)).groupBy("_one").applyInPandas(lambda d: _closed(d)[[f.split()[0] for f in fields.split(", ")]], fields), "open")
    # the parent of a closed node is looked up by run: a node that many runs share is no hot key
    known = opened.select("run", "open_id").join(closed.select("open_id", F.col("conv_id").alias("_conv")), "open_id").select("run", F.col("open_id").alias("parent_open"), "_conv")
    inner = rows.where("open_id IS NULL")
    hanging = inner.where("parent_open IS NOT NULL").join(known, ["run", "parent_open"]).withColumn("parent_conv_id", F.col("_conv"))
    return inner.where("parent_open IS NULL").select(*names).unionByName(hanging.select(*names)).unionByName(closed.select(*names))


def rebuilt(convs: DataFrame, every: int = 20, most: int = 4) -> DataFrame:
    """convs (conv_id, turns), each with its first turns taken from conversation c - c % every: as many as crc32 of its decimal id, modulo
    `most`; then its own beyond that number. All turns of a shorter conversation, none of an absent one."""
    c, none = F.col("conv_id"), F.array().cast(convs.schema["turns"].dataType)
    heads = convs.where(c % every == 0).select(c.alias("_base"), F.slice("turns", 1, most - 1).alias("_head"))
    taken = (F.crc32(c.cast("string").cast("binary")) % most).cast("int")
    joined = convs.withColumn("_taken", taken).join(heads, (c - c % every) == F.col("_base"), "left")
    turns = F.concat(F.slice(F.coalesce("_head", none), F.lit(1), F.col("_taken")), F.slice("turns", F.col("_taken") + 1, F.size("turns")))
    return joined.select("conv_id", turns.alias("turns"))


def op13_prefix_trie(spark, sf_dir: str) -> DataFrame:
    return prefix_trie(rebuilt(turns_of(read(spark, sf_dir, "conversations"))))


OP13_SQL = f"""WITH t AS ({CRC_TABLE}),
own AS (SELECT conv_id, md5(length(r) || ':' || r || x) AS id, len(regexp_extract_all(x, '[^\\x20\\x09-\\x0D]+')) AS words,
    row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, md5(length(r) || ':' || r || x)) AS k
  FROM (SELECT conv_id, turn, coalesce(role, '') AS r, coalesce(text, '') AS x FROM conversations WHERE conv_id IS NOT NULL)),
sizes AS (SELECT conv_id, count(*) AS n FROM own GROUP BY conv_id),
convs AS (SELECT s.conv_id, {crc32_sql("s.conv_id::VARCHAR")} % 4 AS h, coalesce(b.n, 0) AS base_n FROM t, sizes s LEFT JOIN sizes b ON b.conv_id = s.conv_id - s.conv_id % 20),
made AS (SELECT c.conv_id, k AS d, id, words FROM convs c JOIN own o ON o.conv_id = c.conv_id - c.conv_id % 20 WHERE k <= h
  UNION ALL SELECT conv_id, k - h + least(h, base_n), id, words FROM convs c JOIN own o USING (conv_id) WHERE k > h),
strings AS (SELECT conv_id, list(id ORDER BY d) AS ids, list(words ORDER BY d) AS ws FROM convs LEFT JOIN made USING (conv_id) GROUP BY conv_id),
whole AS (SELECT conv_id, list_filter(ids, lambda x: x IS NOT NULL) AS ids, ws FROM strings),
pre AS MATERIALIZED (SELECT conv_id, d, md5(array_to_string(ids[1:d], '')) AS pid, CASE WHEN d > 0 THEN md5(array_to_string(ids[1:d - 1], '')) END AS ppid,
    CASE WHEN d > 0 THEN ws[d] ELSE 0 END AS words, d = len(ids) AS ends FROM (SELECT *, unnest(range(len(ids) + 1)) AS d FROM whole)),
nodes AS MATERIALIZED (SELECT pid, any_value(d) AS depth, min(conv_id) AS conv_id, any_value(ppid) AS ppid, count(*) AS n_convs, any_value(words) AS words,
    sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (WHERE ends), '')) AS ends_sha256 FROM pre GROUP BY pid),
kids AS (SELECT ppid AS pid, count(*) AS n_children FROM nodes WHERE ppid IS NOT NULL GROUP BY ppid),
own_part AS (SELECT n.*, coalesce(n_children, 0) AS n_children FROM nodes n LEFT JOIN kids USING (pid)),
below AS (SELECT p.pid, sum(CASE WHEN n.n_children = 0 THEN 1 ELSE 0 END) AS n_leaves, sum((n.n_convs - 1) * n.words) AS saved_tokens
  FROM own_part n JOIN pre p ON p.conv_id = n.conv_id AND p.d <= n.depth GROUP BY p.pid)
SELECT n.conv_id, n.depth, q.conv_id AS parent_conv_id, n.n_convs, n.n_children, n_leaves::BIGINT AS n_leaves, saved_tokens::BIGINT AS saved_tokens, n.ends_sha256
FROM own_part n JOIN below USING (pid) LEFT JOIN nodes q ON q.pid = n.ppid"""
