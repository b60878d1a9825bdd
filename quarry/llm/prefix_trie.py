"""The trie of shared conversation prefixes, with subtree totals by time-forward processing."""

from __future__ import annotations

import hashlib
import heapq
import tempfile
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.llm.ordered import in_order
from quarry.llm.worker import bounded_batches, tidy
from quarry.storage import materialise

#: Ids of conversations that go in one piece of the list that is hashed for a node.
PIECE = 4096
TOTALS = ("children", "leaves", "saved")


class SpillingQueue:
    """A priority queue of equal-length tuples of integers. Beyond ``room`` the later half goes, sorted, to a
    scratch file of this task, which has no name and is gone with the process; a queue holds one open block of each."""

    BLOCK = 4096

    def __init__(self, room: int):
        self.room, self.heap, self.runs, self.opened = max(2, room), [], [], 0

    def push(self, item: tuple) -> None:
        heapq.heappush(self.heap, item)
        if len(self.heap) > self.room:
            self.heap.sort()
            half = len(self.heap) // 2
            self._open(self._run(np.array(self.heap[half:], np.int64)))
            del self.heap[half:]

    def _run(self, rows: np.ndarray) -> Iterator[tuple]:
        with tempfile.TemporaryFile() as f:
            rows.tofile(f)
            f.seek(0)
            width = rows.shape[1]
            del rows
            while block := f.read(8 * width * self.BLOCK):
                yield from map(tuple, np.frombuffer(block, np.int64).reshape(-1, width).tolist())

    def _open(self, run: Iterator[tuple]) -> None:
        head = next(run, None)
        if head is not None:
            self.opened += 1
            heapq.heappush(self.runs, (head, self.opened, run))

    def pop(self, key: tuple) -> Iterator[tuple]:
        """Take all items that begin with ``key``, which no item in the queue is smaller than."""
        n = len(key)
        while self.heap and self.heap[0][:n] == key:
            yield heapq.heappop(self.heap)
        while self.runs and self.runs[0][0][:n] == key:
            head, *_, run = heapq.heappop(self.runs)
            self._open(run)
            yield head

    def __len__(self) -> int:
        return len(self.heap) + len(self.runs)


def rebuilt_conversations(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", group: int = 5, heads: int = 9) -> tuple[DataFrame, DataFrame]:
    """Conversations that share openings: every conv_id c begins with the first h turns of c - c % ``group`` (all if it has fewer, none
    if there is no such conversation) and goes on with its own turns after its first h; h = crc32(c as text) % ``heads``.

    Turns are in the order of their number (nulls first); equal numbers by the digest of role and text. Null roles and texts are empty, a turn with a
    null conv_id belongs to none. Columns: (conv, position, key, bytes) of every turn, with a digest of
    role and text in place of them, and (conv, n_turns) of every conversation, turnless ones included.
    """
    role, text = (F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")) for c in (role_col, text_col))
    key = F.md5(F.concat(F.md5(role.cast("binary")), F.md5(text.cast("binary"))).cast("binary"))
    narrow = turns.select(F.col(f"`{conv_col}`").cast("long").alias("conv"), F.col(f"`{turn_col}`").cast("long").alias("turn"), key.alias("key"), F.octet_length(text).cast("long").alias("bytes"))
    placed = materialise(in_order(materialise(narrow.filter("conv is not null"), "turns"), "conv", ["turn", "key"]).drop("turn"), "placed")
    sizes = materialise(placed.groupBy("conv").agg(F.count("*").alias("n")), "sizes")
    base = sizes.select(F.col("conv").alias("base"), F.col("n").alias("n_base"))
    h = F.crc32(F.col("conv").cast("string").cast("binary")) % heads
    plans = sizes.withColumns({"h": h, "base": F.col("conv") - F.col("conv") % group}).join(base, "base", "left")
    plans = materialise(plans.withColumn("taken", F.least("h", F.coalesce("n_base", F.lit(0)))), "plans")
    opening = placed.filter(F.col("position") < heads - 1).withColumnRenamed("conv", "base").join(plans.select("conv", "base", "h"), "base").filter("position < h")
    own = placed.join(plans.select("conv", "h", "taken"), "conv").filter("position >= h").withColumn("position", F.col("position") - F.col("h") + F.col("taken"))
    columns = ("conv", "position", "key", "bytes")
    return materialise(opening.select(*columns).union(own.select(*columns)), "rebuilt"), plans.select("conv", (F.col("taken") + F.greatest(F.col("n") - F.col("h"), F.lit(0))).alias("n_turns"))


def prefix_nodes(turns: DataFrame, convs: DataFrame) -> DataFrame:
    """Nodes (conv, depth, parent, n_convs, own, ends_sha256) of the trie; conv is the smallest member, parent that of the parent.

    A prefix is known by two 64-bit hashes, the exclusive-or over its turns of the hash of each turn at its place, so they follow from
    running exclusive-ors in any number of partitions. ``own`` is (n_convs - 1) times the bytes of the last text.
    """
    hashes = materialise(turns.withColumns({"p1": F.xxhash64("position", "key"), "p2": F.xxhash64("key", F.lit(11), "position")}), "hashes")
    hashes = hashes.withColumns({"q1": F.col("p1"), "q2": F.col("p2")})
    paths = in_order(hashes.drop("key").withColumnRenamed("position", "at"), "conv", ["at"], ["p1", "p2"])
    paths = paths.withColumns({"q1": F.col("q1").bitwiseXOR(F.col("p1")), "q2": F.col("q2").bitwiseXOR(F.col("p2")), "depth": F.col("position") + 1})
    paths = materialise(paths.select("conv", "depth", "p1", "p2", "q1", "q2", "bytes"), "paths")
    at = ("depth", "p1", "p2")
    deep = materialise(paths.groupBy(*at).agg(F.min("conv").alias("conv"), F.count("*").alias("n_convs"), *(F.min(c).alias(c) for c in ("q1", "q2", "bytes"))), "prefixes")
    root = convs.agg(F.min("conv").alias("conv"), F.count("*").alias("n_convs")).filter("n_convs > 0")
    parents = deep.select((F.col("depth") + 1).alias("depth"), F.col("p1").alias("q1"), F.col("p2").alias("q2"), F.col("conv").alias("parent"))
    top = deep.filter("depth = 1").crossJoin(F.broadcast(root.select(F.col("conv").alias("parent"))))  # one row
    columns = (*at, "conv", "parent", "n_convs", "bytes")
    nodes = top.select(*columns).union(deep.filter("depth > 1").join(parents, ["depth", "q1", "q2"]).select(*columns))
    zero = F.lit(0).cast("long")
    nodes = nodes.union(root.select(zero, zero, zero, "conv", F.lit(None).cast("long"), "n_convs", zero))

    last = paths.join(convs, "conv").filter("depth = n_turns").select(*at, "conv").union(convs.filter("n_turns = 0").select(zero, zero, zero, "conv"))
    pieces = last.groupBy(*at, F.floor(F.col("conv") / PIECE).alias("piece")).agg(F.array_join(F.sort_array(F.collect_list("conv")).cast("array<string>"), ",").alias("ids"))
    digests = pieces.repartition(*(F.col(c) for c in at)).sortWithinPartitions(*at, "piece").mapInArrow(tidy(_digests), "depth long, p1 long, p2 long, ends_sha256 string")
    none = F.lit(hashlib.sha256(b"").hexdigest())
    out = nodes.join(digests, [*at], "left").withColumn("own", (F.col("n_convs") - 1) * F.col("bytes"))
    return materialise(out.select("conv", "depth", "parent", "n_convs", "own", F.coalesce("ends_sha256", none).alias("ends_sha256")), "nodes")


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One digest for each node, whose pieces come one after another; nothing but the hash's state is held."""
    at, digest = None, None
    for batch in batches:
        done = []
        for *key, _, ids in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if key == at:
                digest.update(b",")
            else:
                if digest:
                    done.append((*at, digest.hexdigest()))
                at, digest = key, hashlib.sha256()
            digest.update(ids.encode())
        yield _batch(done, ("depth", "p1", "p2"), "ends_sha256")
    if digest:
        yield _batch([(*at, digest.hexdigest())], ("depth", "p1", "p2"), "ends_sha256")


def _batch(rows: list[tuple], longs: tuple, *strings: str) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) if rows else [()] * (len(longs) + len(strings))
    kinds = [pa.int64()] * len(longs) + [pa.string()] * len(strings)
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], [*longs, *strings])


class Shards:
    """A shard is a range of smallest members and of depths, so its size is bounded and every row's shard is known from its key."""

    def __init__(self, convs: int, levels: int, room: int):
        self.convs, self.levels, self.room = convs, levels, room

    def of(self, conv: str, depth: Column) -> list[Column]:
        return [F.floor(F.col(conv) / self.convs), F.floor(depth / self.levels)]

    def away(self) -> Column:
        """Whether a node's parent is in another shard; null for the root."""
        return F.when(F.col("parent").isNotNull(), F.struct(*self.of("conv", F.col("depth"))) != F.struct(*self.of("parent", F.col("depth") - 1)))

    def _sorted(self, rows: DataFrame, *order: Column) -> DataFrame:
        shard = dict(zip(("s", "l"), self.of("conv", F.col("depth")), strict=True))
        return rows.withColumns(shard).repartition("s", "l").sortWithinPartitions("s", "l", *order)

    def totals(self, nodes: DataFrame, portals: DataFrame, messages: DataFrame) -> DataFrame:
        """(conv, depth, children, leaves, saved) of every node from the nodes below it in its shard and from ``messages``.

        Nodes come in reverse level order, sorted by Spark; each takes what was sent to it from the queue and sends its
        totals on to its parent. A node in ``portals`` has children in other shards.
        """
        room = self.room
        flagged = nodes.join(portals.select("conv", "depth", F.lit(1).alias("portal")), ["conv", "depth"], "left")
        zero = F.lit(0).cast("long")
        rows = flagged.select("conv", "depth", "parent", "own", F.coalesce("portal", F.lit(0)).cast("long").alias("portal"), F.coalesce(self.away(), F.lit(True)).alias("away"), *(zero.alias(c) for c in TOTALS), F.lit(1).alias("node"))
        sent = messages.select("conv", "depth", F.lit(None).cast("long"), zero, zero, F.lit(True), *TOTALS, F.lit(0))

        def sweep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            queue, shard = SpillingQueue(room), None
            for batch in batches:
                done = []
                for conv, depth, parent, own, portal, away, *sent, node, s, l in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                    if (s, l) != shard:
                        if len(queue):
                            raise RuntimeError("totals were sent to a node that isn't in its shard")
                        shard = s, l
                    at = -depth, -conv
                    if not node:
                        queue.push((*at, *sent))
                        continue
                    children = leaves = saved = 0
                    for *_, c, n, x in queue.pop(at):
                        children, leaves, saved = children + c, leaves + n, saved + x
                    leaves, saved = leaves or int(not children and not portal), saved + own
                    done.append((conv, depth, children, leaves, saved))
                    if not away:
                        queue.push((1 - depth, -parent, 1, leaves, saved))
                yield _batch(done, ("conv", "depth", *TOTALS))

        sorted_rows = self._sorted(rows.union(sent), F.desc("depth"), F.desc("conv"), F.col("node"))
        return sorted_rows.mapInArrow(tidy(sweep), "conv long, depth long, children long, leaves long, saved long")

    def tops(self, nodes: DataFrame, portals: DataFrame) -> DataFrame:
        """For every portal, what is above the part of its shard that it is in: (conv, depth, up_conv, up_depth), null in the root's part.

        Nodes come in level order; what is held are the parts of two levels, which a shard's range of members bounds.
        """
        flagged = nodes.join(portals.select("conv", "depth", F.lit(1).alias("portal")), ["conv", "depth"], "left")
        rows = flagged.select("conv", "depth", "parent", F.coalesce("portal", F.lit(0)).alias("portal"), F.coalesce(self.away(), F.lit(True)).alias("away"))

        def sweep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            above, level, at = {}, {}, None
            for batch in batches:
                done = []
                for conv, depth, parent, portal, away, s, l in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                    if at != (s, l, depth):
                        above, level, at = level if at == (s, l, depth - 1) else {}, {}, (s, l, depth)
                    up = level[conv] = (parent, depth - 1 if depth else None) if away else above[parent]
                    if portal:
                        done.append((conv, depth, *up))
                yield _batch(done, ("conv", "depth", "up_conv", "up_depth"))

        return self._sorted(rows, F.col("depth"), F.col("conv")).mapInArrow(tidy(sweep), "conv long, depth long, up_conv long, up_depth long")


def _across(shards: Shards, nodes: DataFrame, portals: DataFrame) -> DataFrame:
    """What all shards below send to each portal: (conv, depth, children, leaves, saved).

    The parts of one shard that hang under the same portal are one row, with the row above it that the portal's own part belongs to. Totals
    go up these rows twice as far every round, so a chain over many shards takes few rounds.
    """
    own = shards.totals(nodes, portals, portals.select("conv", "depth", *(F.lit(0).cast("long").alias(c) for c in TOTALS)).limit(0))
    roots = nodes.filter(shards.away()).select("conv", "depth", "parent").join(own.select("conv", "depth", "leaves", "saved"), ["conv", "depth"])
    s, l = shards.of("conv", F.col("depth"))
    parts = roots.groupBy(s.alias("s"), l.alias("l"), F.col("parent").alias("conv"), (F.col("depth") - 1).alias("depth")).agg(F.count("*").alias("children"), F.sum("leaves").alias("leaves"), F.sum("saved").alias("saved"))
    placed = parts.join(shards.tops(nodes, portals), ["conv", "depth"])
    up = F.when(F.col("up_conv").isNotNull(), F.struct(*(c.alias(n) for c, n in zip(shards.of("conv", F.col("depth")), "sl", strict=True)), F.col("up_conv").alias("conv"), F.col("up_depth").alias("depth")))
    rows = materialise(placed.select(F.struct("s", "l", "conv", "depth").alias("id"), up.alias("up"), "children", "leaves", "saved"), "parts")
    while rows.filter("up is not null").limit(1).count():
        sent = rows.filter("up is not null").groupBy(F.col("up").alias("id")).agg(F.sum("leaves").alias("more_leaves"), F.sum("saved").alias("more_saved"))
        further = rows.select(F.col("id").alias("up"), F.col("up").alias("next"))
        moved = rows.join(sent, "id", "left").join(further, "up", "left")
        rows = materialise(moved.select("id", F.col("next").alias("up"), "children", *((F.col(c) + F.coalesce(f"more_{c}", F.lit(0))).alias(c) for c in ("leaves", "saved"))), "parts")
    return rows.groupBy("id.conv", "id.depth").agg(*(F.sum(c).alias(c) for c in TOTALS))


def prefix_trie(
    turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text",
    shard_convs: int = 2048, shard_levels: int = 2048, queue_room: int = 1 << 14,
) -> DataFrame:
    """A row for every node of the trie of rebuilt conversations (``rebuilt_conversations``): every distinct sequence of first turns.

    Columns: conv_id (smallest member), depth, parent_conv_id (null at the root), n_convs (members), n_children, n_leaves (childless nodes of
    the subtree), saved_tokens (over the subtree, (n_convs - 1) times the bytes of the last text), all long, and ends_sha256
    (of the decimal ids of the conversations that end here, ascending, joined by commas). A node is (conv_id, depth): nodes with one smallest member are a chain.

    Texts are hashed where they lie; only narrow rows are shuffled. A shard holds the nodes of ``shard_convs`` smallest members and
    ``shard_levels`` levels. Within a shard nodes come in reverse level order and send their totals up through a queue that
    spills beyond ``queue_room`` entries; then totals go across the shards' roots, and a second sweep takes in what came from
    other shards. So no task holds a conversation, a subtree or a level. The ids of a node that many conversations end at
    go to its hash in pieces of PIECE, one after another, as SHA-256 needs.

    Rows with a null conv_id are left out; null roles and texts are empty, turns of equal number are ordered by digest and repeated ones kept; an empty table
    gives no rows; other columns are ignored.
    """
    bounded_batches(turns.sparkSession)
    shards = Shards(shard_convs, shard_levels, queue_room)
    rebuilt, convs = rebuilt_conversations(turns, conv_col, turn_col, role_col, text_col)
    nodes = prefix_nodes(rebuilt, convs)
    portals = materialise(nodes.filter(shards.away()).select(F.col("parent").alias("conv"), (F.col("depth") - 1).alias("depth")).distinct(), "portals")
    messages = _across(shards, nodes, portals) if portals.limit(1).count() else portals.select("conv", "depth", *(F.lit(0).cast("long").alias(c) for c in TOTALS))
    totals = shards.totals(nodes, portals, messages)
    return nodes.join(totals, ["conv", "depth"]).select(
        F.col("conv").alias("conv_id"), "depth", F.col("parent").alias("parent_conv_id"), "n_convs", F.col("children").alias("n_children"),
        F.col("leaves").alias("n_leaves"), F.col("saved").alias("saved_tokens"), "ends_sha256",
    )


def trie_sql(group: int = 5, heads: int = 9) -> str:
    """``prefix_trie`` of conversations in DuckDB SQL; the check sum goes bit by bit."""
    crc = "xor(list_reduce(list_prepend(4294967295, flatten(list_transform(string_split(CAST(n.c AS VARCHAR), ''), lambda ch: list_transform(range(8), lambda i: (ascii(ch) >> i) & 1)))), lambda a, b: xor(a >> 1, 3988292384 * (xor(a, b) & 1))), 4294967295)"
    return f"""
    WITH t AS (SELECT conv_id AS c, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL),
    o AS (SELECT c, role, text, row_number() OVER (PARTITION BY c ORDER BY turn NULLS FIRST, md5(md5(role) || md5(text))) - 1 AS pos FROM t),
    n AS (SELECT c, count(*) AS n FROM o GROUP BY c),
    p AS (SELECT n.c, {crc} % {heads} AS h, n.c - n.c % {group} AS base, coalesce(b.n, 0) AS nb FROM n LEFT JOIN n b ON b.c = n.c - n.c % {group}),
    r AS (SELECT p.c, o.pos, o.role, o.text FROM p JOIN o ON o.c = p.base AND o.pos < p.h UNION ALL SELECT p.c, o.pos - p.h + least(p.h, p.nb), o.role, o.text FROM p JOIN o ON o.c = p.c AND o.pos >= p.h),
    k AS (SELECT c, pos + 1 AS depth, string_agg(sha256(md5(role) || sha256(text)), '' ORDER BY pos) OVER (PARTITION BY c ORDER BY pos) AS path, octet_length(encode(text)) AS bytes FROM r
          UNION ALL SELECT c, 0, '', 0 FROM p),
    m AS (SELECT depth, path, min(c) AS conv, count(*) AS n_convs, (count(*) - 1) * any_value(bytes) AS own FROM k GROUP BY depth, path),
    l AS (SELECT c, max(depth) AS depth FROM k GROUP BY c),
    e AS (SELECT depth, path, string_agg(CAST(c AS VARCHAR), ',' ORDER BY c) AS ids FROM l JOIN k USING (c, depth) GROUP BY depth, path),
    a AS (SELECT m.depth, m.path, x.conv AS parent, m.conv, m.n_convs, m.own, sha256(coalesce(e.ids, '')) AS ends_sha256 FROM m LEFT JOIN m x ON x.depth = m.depth - 1 AND x.path = m.path[1:64 * (m.depth - 1)] LEFT JOIN e ON e.depth = m.depth AND e.path = m.path),
    f AS (SELECT parent, depth - 1 AS depth, count(*) AS n FROM a WHERE depth > 0 GROUP BY ALL),
    u AS (SELECT y.conv, y.depth, count(*) FILTER (f.n IS NULL) AS n_leaves, sum(a.own) AS saved FROM a JOIN k ON k.c = a.conv AND k.depth <= a.depth JOIN m y ON y.depth = k.depth AND y.path = k.path
          LEFT JOIN f ON f.parent = a.conv AND f.depth = a.depth GROUP BY y.conv, y.depth)
    SELECT a.conv AS conv_id, a.depth, a.parent AS parent_conv_id, a.n_convs, coalesce(f.n, 0) AS n_children, u.n_leaves, CAST(u.saved AS BIGINT) AS saved_tokens, a.ends_sha256
    FROM a JOIN u ON u.conv = a.conv AND u.depth = a.depth LEFT JOIN f ON f.parent = a.conv AND f.depth = a.depth
    """
