"""The trie of conversation prefixes, built as burst tries.

A turn is known by a 128-bit digest of role and text, a prefix by the XOR of the scattered digests
of its turns and their places, so that keys of parts combine. Conversations are cut into stretches
of a bounded number of turns; a stretch hangs under the prefix it starts at. Equal stretches under one prefix
are one suffix with a weight.

1. All suffixes under one prefix are a container. One that holds too many bursts: its prefix
   becomes a trie head, and its suffixes go to new containers by their next turn.
2. The containers that are left are dealt to shards of bounded size. A shard sorts its suffixes
   and sweeps over them with a stack of open nodes: a node closes with the sums of its subtree.
3. What a container or a further stretch adds to nodes above it is summed by those nodes' keys.

Texts and ids are never gathered: text stays where it is read, and the digest of a node's ids
is taken from sorted blocks of them.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vigilframe.llm.words import STEP, has_rows, scatter, settle

ROUND, MOST_SHARED = 100, 6  # conversations of a round share their first turns: up to MOST_SHARED - 1


@dataclass(frozen=True)
class Limits:
    """What a row, a container and a shard hold at most. Results don't depend on it."""

    stretch: int = 1 << 8  # turns of a suffix
    suffixes: int = 1 << 11  # of a container
    turns: int = 1 << 15  # of a container of several suffixes
    shard: int = 1 << 15  # turns, on average
    block: int = 1 << 12  # ids in one row before their digest is taken


SUFFIX = ("stretch long, k1 long, k2 long, taken int, ids binary, lens binary, turns int, conv_id long, n_convs long, n_more long, "
          "above_conv_id long, above_known boolean")
NODE = ["k1", "k2", "depth", "conv_id", "n_convs", "n_children", "n_leaves", "saved"]
SWEPT = ("kind int, k1 long, k2 long, depth long, conv_id long, n_convs long, n_children long, n_leaves long, saved long, "
         "parent_conv_id long, p1 long, p2 long, stretch long")
KIND_NODE, KIND_PART, KIND_OWNED = 0, 1, 2


def place_keys(ids: bytes, first: int) -> np.ndarray:
    """Two 64-bit numbers for each turn of `ids` (16 bytes each) at the places from `first` on."""
    halves = np.frombuffer(ids, "<u8").reshape(-1, 2)
    places = (np.arange(first, first + len(halves)).astype(np.uint64) + np.uint64(1)) * STEP
    return scatter(scatter(halves ^ np.array([0, 0x5BD1E995], np.uint64)) ^ places[:, None])


def prefix_keys(ids: bytes, first: int, k1: int, k2: int) -> np.ndarray:
    """The keys after 0, 1, ... turns of `ids`, as signed numbers."""
    keys = place_keys(ids, first)
    start = np.array([[k1, k2]], np.int64).view(np.uint64)
    return np.bitwise_xor.accumulate(np.concatenate([start, keys]), axis=0).view(np.int64)


# ---------------------------------------------------------------- rebuilt conversations

def numbered(turns: DataFrame) -> DataFrame:
    """(conv_id, place, id, length) of all turns, numbered from 0 in each conversation.

    Rows are range-sorted, so that a conversation of any length spreads over tasks; each task
    numbers its own rows and the counts of the tasks before are added.
    """
    spread = F.monotonically_increasing_id()  # parts equal rows; which of them comes first makes no difference
    rows = turns.where("conv_id is not null").select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"),
        F.unhex(F.md5(F.concat(F.length(F.coalesce("role", F.lit(""))).cast("string"), F.lit(":"), F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))))).alias("id"),
        F.coalesce(F.length("text"), F.lit(0)).cast("long").alias("length"), spread.alias("spread"))
    order = ["conv_id", F.col("turn").asc_nulls_first(), "id", "spread"]
    rows = settle(rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("task", F.spark_partition_id()))

    here = Window.partitionBy("conv_id", "task").orderBy(F.col("turn").asc_nulls_first(), "id", "spread")
    counts = rows.groupBy("conv_id", "task").agg(F.count("*").alias("n"))
    earlier = Window.partitionBy("conv_id").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    before = counts.withColumn("before", F.sum("n").over(earlier)).where("before > 0").select("conv_id", "task", "before")
    # At most one row for each task: those whose first conversation began in another one.
    return rows.withColumn("place", F.row_number().over(here) - 1).join(F.broadcast(before), ["conv_id", "task"], "left").select(
        "conv_id", (F.col("place") + F.coalesce("before", F.lit(0))).cast("long").alias("place"), "id", "length")


def rebuilt(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """All conversations (conv_id), and their rebuilt turns (conv_id, place, id, length)."""
    own = settle(numbered(turns))
    convs = settle(own.select("conv_id").distinct())
    first = own.where((F.col("place") < MOST_SHARED - 1) & (F.col("conv_id") % ROUND == 0)).groupBy(F.col("conv_id").alias("round")).agg(
        F.sort_array(F.collect_list(F.struct("place", "id", "length"))).alias("first"))
    share = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % MOST_SHARED).cast("int")
    given = convs.withColumn("round", F.col("conv_id") - F.col("conv_id") % ROUND).join(first, "round", "left").select(
        "conv_id", share.alias("share"), F.slice(F.coalesce("first", F.array().cast("array<struct<place:long,id:binary,length:long>>")), 1, share).alias("first"))
    given = settle(given.withColumn("given", F.size("first").cast("long")))
    shared = given.select("conv_id", F.explode("first").alias("t")).select("conv_id", "t.*")
    rest = own.join(given.select("conv_id", "share", "given"), "conv_id").where("place >= share").select(
        "conv_id", (F.col("place") - F.col("share") + F.col("given")).alias("place"), "id", "length")
    return convs, shared.unionByName(rest)


# ---------------------------------------------------------------- suffixes

def stretches(turns: DataFrame, size: int) -> DataFrame:
    """(conv_id, stretch, ids, lens, turns, x1, x2): the stretches of rebuilt conversations and their own keys."""
    lists = turns.groupBy("conv_id", F.floor(F.col("place") / size).alias("stretch")).agg(
        F.sort_array(F.collect_list(F.struct("place", "id", "length"))).alias("t"))
    lists = lists.select("conv_id", "stretch", F.col("t.id").alias("ids"), F.col("t.length").alias("lens"))

    def run(batches):
        for batch in batches:
            ids = [b"".join(x) for x in batch.column(2).to_pylist()]
            keys = [np.bitwise_xor.reduce(place_keys(x, s * size), axis=0).view(np.int64).tolist()
                    for x, s in zip(ids, batch.column(1).to_pylist())]
            lens = [np.array(x, "<i8").tobytes() for x in batch.column(3).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(ids, pa.binary()), pa.array(lens, pa.binary()),
                 pa.array([len(x) // 16 for x in ids], pa.int32()), pa.array([k[0] for k in keys], pa.int64()), pa.array([k[1] for k in keys], pa.int64())],
                names=["conv_id", "stretch", "ids", "lens", "turns", "x1", "x2"])

    return lists.mapInArrow(run, "conv_id long, stretch long, ids binary, lens binary, turns int, x1 long, x2 long")


def placed(rows: DataFrame, size: int) -> DataFrame:
    """Adds to each stretch the key it starts at (k1, k2) and `more`: whether another one follows.

    Only conversations that may have several stretches are looked at, without their ids.
    """
    whole = (F.col("stretch") == 0) & (F.col("turns") < size)
    zero = F.lit(0).cast("long")
    short = rows.where(whole).withColumn("k1", zero).withColumn("k2", zero).withColumn("more", F.lit(False))
    earlier = Window.partitionBy("conv_id").orderBy("stretch").rowsBetween(Window.unboundedPreceding, -1)
    ahead = Window.partitionBy("conv_id").orderBy("stretch")
    keys = rows.where(~whole).select(
        "conv_id", "stretch", F.coalesce(F.bit_xor("x1").over(earlier), zero).alias("k1"), F.coalesce(F.bit_xor("x2").over(earlier), zero).alias("k2"),
        F.lead("stretch").over(ahead).isNotNull().alias("more"))
    return short.unionByName(rows.where(~whole).join(keys, ["conv_id", "stretch"]))


def suffixes_of(rows: DataFrame, root: Column) -> DataFrame:
    """Equal stretches under one prefix as one row: smallest conversation, how many, how many go on.

    above_conv_id is the smallest member of the node above the container, where it is known:
    the root's now, a head's when it bursts.
    """
    return rows.groupBy("stretch", "k1", "k2", "x1", "x2").agg(
        F.first("ids").alias("ids"), F.first("lens").alias("lens"), F.first("turns").alias("turns"), F.min("conv_id").alias("conv_id"),
        F.count("*").alias("n_convs"), F.count_if("more").alias("n_more"),
    ).select("stretch", "k1", "k2", F.lit(0).alias("taken"), "ids", "lens", "turns", "conv_id", "n_convs", "n_more",
             F.coalesce(root, F.lit(0)).cast("long").alias("above_conv_id"), (F.col("stretch") == 0).alias("above_known"))


CONTAINER = ["stretch", "k1", "k2"]


def burst(held: DataFrame, limits: Limits) -> tuple[DataFrame, DataFrame | None]:
    """Suffixes in containers of bounded size, and the heads of those that were burst.

    A head: its container's key, taken (turns below the stretch's start), smallest conversation,
    members, and one member's ids and lengths, which hold the path to it.
    """
    done, heads = [], []
    held = settle(held)
    while True:
        sizes = held.groupBy(*CONTAINER).agg(F.count("*").alias("suffixes"), F.sum(F.col("turns") - F.col("taken")).alias("left"), F.min("conv_id").alias("head_conv_id"))
        large = settle(sizes.where((F.col("suffixes") > limits.suffixes) | ((F.col("left") > limits.turns) & (F.col("suffixes") > 1))).select(*CONTAINER, "head_conv_id"))
        if not has_rows(large):
            done.append(held)
            break
        done.append(held.join(large.drop("head_conv_id"), CONTAINER, "left_anti"))
        open_ones = settle(held.join(large, CONTAINER))
        heads.append(open_ones.groupBy(*CONTAINER, "taken").agg(
            F.min("conv_id").alias("conv_id"), F.sum("n_convs").alias("n_convs"), F.min(F.struct("conv_id", "ids", "lens")).alias("path"),
            F.first("above_conv_id").alias("above_conv_id"), F.first("above_known").alias("above_known"),
        ).select(*CONTAINER, "taken", "conv_id", "n_convs", "path.ids", "path.lens", "above_conv_id", "above_known"))
        below = open_ones.where("taken < turns").withColumn("above_conv_id", F.col("head_conv_id")).withColumn(
            "above_known", F.lit(True)).drop("head_conv_id")
        held = settle(next_containers(below, limits.stretch))
    rest = done[0]
    for more in done[1:]:
        rest = rest.unionByName(more)
    united = None
    for more in heads:
        united = more if united is None else united.unionByName(more)
    return rest, united


def next_containers(rows: DataFrame, size: int) -> DataFrame:
    """Each suffix under the key of its prefix and next turn."""
    def run(batches):
        for batch in batches:
            columns = {n: c.to_pylist() for n, c in zip(batch.schema.names, batch.columns) if n in ("stretch", "k1", "k2", "taken", "ids")}
            keys = [prefix_keys(ids[16 * t : 16 * t + 16], s * size + t, k1, k2)[1].tolist()
                    for s, k1, k2, t, ids in zip(*[columns[n] for n in ("stretch", "k1", "k2", "taken", "ids")])]
            new = {"k1": pa.array([k[0] for k in keys], pa.int64()), "k2": pa.array([k[1] for k in keys], pa.int64()),
                   "taken": pa.array([t + 1 for t in columns["taken"]], pa.int32())}
            yield pa.RecordBatch.from_arrays([new.get(n, c) for n, c in zip(batch.schema.names, batch.columns)], names=batch.schema.names)

    return rows.mapInArrow(run, SUFFIX)


# ---------------------------------------------------------------- sweep

class Sweep:
    """Rows of the nodes under containers whose suffixes come in sorted order."""

    def __init__(self, size: int):
        self.size = size
        self.rows: list[tuple] = []
        self.stack: list[list] = []  # open nodes: key, depth, length, conv, members, children, leaves, saved, goes on, children's rows
        self.owned: dict[tuple[int, int], list[int]] = {}

    def open(self, key, depth: int, length: int) -> None:
        self.stack.append([key, depth, length, None, 0, 0, 0, 0, False, []])

    def close(self, stretch: int) -> list:
        key, depth, length, conv, members, children, leaves, saved, goes_on, below = self.stack.pop()
        leaf = not children and not goes_on
        leaves += leaf
        worth = (members - 1) * length
        saved += worth
        for row in below:
            row[9] = conv
        row = [KIND_NODE, *key, depth, conv, members, children, leaves, saved, None, None, None, None]
        self.rows.append(row)
        if stretch:  # later stretches tell the earlier ones of their conversation what they hold
            held = self.owned.setdefault((conv, stretch), [0, 0])
            held[0] += worth
            held[1] += leaf
        if self.stack:
            up = self.stack[-1]
            up[3] = conv if up[3] is None else min(up[3], conv)
            up[4] += members
            up[5] += 1
            up[6] += leaves
            up[7] += saved
            up[9].append(row)
        return row

    def part(self, key, children: int, leaves: int, saved: int) -> None:
        self.rows.append([KIND_PART, *key, None, None, None, children, leaves, saved, None, None, None, None])

    def container(self, stretch: int, taken: int, above_conv: int | None, rows: list) -> None:
        """One container: (ids, lens, conv, members, going on) of its suffixes, sorted by ids."""
        base = stretch * self.size
        ids, lens = rows[0][0], rows[0][1]
        path = prefix_keys(ids[: 16 * taken], base, *self.start).tolist()
        above = path[-2] if taken else path[-1]
        tops: list[list] = []
        previous = b""
        if taken:
            self.open(path[-1], base + taken, lens[taken - 1])
        floor = len(self.stack)
        for ids, lens, conv, members, more in rows:
            ids = ids[16 * taken :]
            shared = common_turns(previous, ids)
            while len(self.stack) - floor > shared:
                tops += self.closed_top(stretch, floor)
            new = prefix_keys(ids[16 * shared :], base + taken + shared, *(self.stack[-1][0] if self.stack else path[-1])).tolist()
            for n, key in enumerate(new[1:], taken + shared + 1):
                self.open(key, base + n, lens[n - 1])
            last = self.stack[-1]
            last[3] = conv if last[3] is None else min(last[3], conv)
            last[4] += members
            last[8] |= more > 0
            previous = ids
        while self.stack:
            tops += self.closed_top(stretch, 0)
        for row in tops:
            row[9:13] = [above_conv, *above, stretch]
        leaves, saved = sum(r[7] for r in tops), sum(r[8] for r in tops)
        self.part(above, len(tops), 0, 0)
        # The start of a later stretch is no node of this one: what lies below reaches it by its conversations.
        for key in path[(1 if stretch else 0) : (taken if taken else 1)]:
            self.part(key, 0, leaves, saved)

    def closed_top(self, stretch: int, floor: int) -> list:
        row = self.close(stretch)
        return [] if self.stack else [row]


def common_turns(a: bytes, b: bytes) -> int:
    """Turns that two sequences share at their start."""
    n, at = min(len(a), len(b)), 0
    while at < n and a[at : at + 16] == b[at : at + 16]:
        at += 16
    return at // 16


def sweep_shard(pdf: pd.DataFrame, size: int) -> pd.DataFrame:
    """Rows of the nodes (0), of sums for nodes above (1), and of what conversations hold in later stretches (2)."""
    sweep = Sweep(size)
    lens = [np.frombuffer(x, "<i8").tolist() for x in pdf["lens"]]
    rows = sorted(zip(pdf["stretch"], pdf["k1"], pdf["k2"], pdf["ids"], range(len(pdf))))
    columns = [pdf[c].tolist() for c in ("taken", "conv_id", "n_convs", "n_more")]
    known = [c if there else None for c, there in zip(pdf["above_conv_id"].tolist(), pdf["above_known"].tolist())]
    at = 0
    while at < len(rows):
        key, held = rows[at][:3], []
        while at < len(rows) and rows[at][:3] == key:
            n = rows[at][4]
            held.append((rows[at][3], lens[n], *[c[n] for c in columns[1:]]))
            taken, above = columns[0][n], known[n]
            at += 1
        start = np.array([key[1:]], np.int64).view(np.uint64)
        for turn in place_keys(held[0][0][: 16 * taken], key[0] * size):
            start = start ^ turn
        sweep.start = start.view(np.int64)[0].tolist()  # the key at the stretch's start
        sweep.container(int(key[0]), int(taken), above, held)
    for (conv, stretch), (saved, leaves) in sweep.owned.items():
        sweep.rows.append([KIND_OWNED, None, None, None, conv, None, None, leaves, saved, None, None, None, stretch])
    return swept_frame(sweep.rows)


def swept_frame(rows: list) -> pd.DataFrame:
    names = [c.split()[0] for c in SWEPT.split(", ")]
    columns = zip(*rows) if rows else [[]] * len(names)
    return pd.DataFrame({n: pd.array(c, "int32" if n == "kind" else "Int64") for n, c in zip(names, columns)})


def head_rows(heads: DataFrame, size: int) -> DataFrame:
    """The rows of burst heads, as a sweep gives them; the root's is made elsewhere."""
    def run(batches):
        for pdf in batches:
            sweep = Sweep(size)
            for r in pdf.itertuples(index=False):
                if not r.taken:
                    continue
                start = np.array([[r.k1, r.k2]], np.int64).view(np.uint64) ^ np.bitwise_xor.reduce(
                    place_keys(r.ids[: 16 * r.taken], r.stretch * size), axis=0)
                path = prefix_keys(r.ids[: 16 * r.taken], r.stretch * size, *start.view(np.int64)[0].tolist()).tolist()
                saved = (r.n_convs - 1) * int(np.frombuffer(r.lens, "<i8")[r.taken - 1])
                sweep.rows.append([KIND_NODE, *path[-1], r.stretch * size + r.taken, r.conv_id, r.n_convs, 0, 0, saved,
                                   r.above_conv_id if r.above_known else None, *path[-2], r.stretch])
                sweep.part(path[-2], 1, 0, 0)
                for key in path[(1 if r.stretch else 0) : -1]:
                    sweep.part(key, 0, 0, saved)
                if r.stretch:
                    sweep.rows.append([KIND_OWNED, None, None, None, r.conv_id, None, None, 0, saved, None, None, None, r.stretch])
            yield swept_frame(sweep.rows)

    return heads.mapInPandas(run, SWEPT)


def later_sums(owned: DataFrame, rows: DataFrame, size: int) -> DataFrame:
    """(k1, k2, n_children, n_leaves, saved): what later stretches add to all nodes of the stretches before.

    Only conversations of several stretches take part. Of each one the sums that it is the
    smallest member of are added up from its end, and go to all nodes of its stretch.
    """
    later = Window.partitionBy("conv_id").orderBy(F.col("stretch").desc()).rowsBetween(Window.unboundedPreceding, -1)
    own = owned.groupBy("conv_id", "stretch").agg(F.sum("saved").alias("saved"), F.sum("n_leaves").alias("n_leaves"))
    long = rows.where("more or stretch > 0")
    sums = long.select("conv_id", "stretch").join(own, ["conv_id", "stretch"], "left").select(
        "conv_id", "stretch", F.sum(F.coalesce("saved", F.lit(0))).over(later).alias("saved"),
        F.sum(F.coalesce("n_leaves", F.lit(0))).over(later).alias("n_leaves")).where("saved > 0 or n_leaves > 0")
    by_suffix = long.join(sums, ["conv_id", "stretch"]).groupBy("stretch", "k1", "k2", "x1", "x2").agg(
        F.first("ids").alias("ids"), F.sum("saved").alias("saved"), F.sum("n_leaves").alias("n_leaves"))

    def run(batches):
        for batch in batches:
            for r in batch.to_pylist():
                path = prefix_keys(r["ids"], r["stretch"] * size, r["k1"], r["k2"])
                path = path[1:] if r["stretch"] else path
                n = len(path)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(path[:, 0]), pa.array(path[:, 1]), pa.array(np.zeros(n, np.int64)),
                     pa.array(np.full(n, r["n_leaves"], np.int64)), pa.array(np.full(n, r["saved"], np.int64))],
                    names=["k1", "k2", "n_children", "n_leaves", "saved"])

    return by_suffix.select("stretch", "k1", "k2", "ids", "n_leaves", "saved").mapInArrow(
        run, "k1 long, k2 long, n_children long, n_leaves long, saved long")


def ends(convs: DataFrame, rows: DataFrame, block: int) -> DataFrame:
    """(k1, k2, ends_sha256) of the nodes at which conversations end; ids ascend, joined by commas.

    A digest has to be taken in order: sorted blocks of ids are made in parallel, and one task
    reads a node's blocks one by one.
    """
    last = rows.where("not more").select("conv_id", F.col("k1").bitwiseXOR(F.col("x1")).alias("k1"), F.col("k2").bitwiseXOR(F.col("x2")).alias("k2"))
    none = convs.join(last, "conv_id", "left_anti").select("conv_id", F.lit(0).cast("long").alias("k1"), F.lit(0).cast("long").alias("k2"))
    order = ["k1", "k2", "conv_id"]
    placed_ids = last.unionByName(none).repartitionByRange(*order).sortWithinPartitions(*order)

    def blocks(batches):
        for batch in batches:
            k1, k2, convs_ = (batch.column(batch.schema.get_field_index(c)).to_numpy() for c in ("k1", "k2", "conv_id"))
            cuts = np.flatnonzero((k1[1:] != k1[:-1]) | (k2[1:] != k2[:-1])) + 1
            out = []
            for s, e in zip([0, *cuts.tolist()], [*cuts.tolist(), len(k1)]):
                for at in range(s, e, block):
                    part = convs_[at : min(e, at + block)].tolist()
                    out.append((int(k1[s]), int(k2[s]), part[0], ",".join(map(str, part))))
            kinds = [pa.int64()] * 3 + [pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(list(zip(*out)) or [[]] * 4, kinds)], names=["k1", "k2", "first", "ids"])

    def digests(batches):
        key, state = None, None
        for batch in batches:
            out = []
            for k1, k2, _, ids in zip(*[c.to_pylist() for c in batch.columns]):
                if (k1, k2) != key:
                    if key:
                        out.append((*key, state.hexdigest()))
                    key, state = (k1, k2), hashlib.sha256(ids.encode())
                else:
                    state.update(b"," + ids.encode())
            yield done(out)
        if key:
            yield done([(*key, state.hexdigest())])

    def done(out):
        kinds = [pa.int64(), pa.int64(), pa.string()]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(list(zip(*out)) or [[]] * 3, kinds)], names=["k1", "k2", "ends_sha256"])

    by_node = placed_ids.mapInArrow(blocks, "k1 long, k2 long, first long, ids string").repartition("k1", "k2").sortWithinPartitions("k1", "k2", "first")
    return by_node.mapInArrow(digests, "k1 long, k2 long, ends_sha256 string")


def trie(turns: DataFrame, limits: Limits = Limits()) -> DataFrame:
    """One row per node: conv_id (smallest member), depth, parent_conv_id, n_convs, n_children, n_leaves,
    saved_tokens, ends_sha256.

    Conversations are rebuilt first: the first h turns of conversation c - c % 100, then c's own
    after its first h; h = crc32(c) % 6. Turns go by `turn`, null first, ties by a digest of role
    and text; repeated rows are turns each. Null role and text are empty. Rows without a conv_id
    belong to no conversation and are left out. An empty table has no nodes, not even a root.
    Other columns are not read.
    """
    convs, built = rebuilt(turns)
    rows = placed(settle(stretches(built, limits.stretch)), limits.stretch)
    held, heads = burst(suffixes_of(rows, convs.agg(F.min("conv_id")).scalar()), limits)
    total = held.agg(F.coalesce(F.sum(F.col("turns") - F.col("taken")), F.lit(0))).scalar()
    shards = F.greatest(F.lit(1), F.ceil(total / F.lit(limits.shard))).cast("long")
    shard = F.pmod(F.xxhash64(*CONTAINER), shards).alias("shard")
    swept = held.groupBy(shard).applyInPandas(lambda pdf: sweep_shard(pdf, limits.stretch), SWEPT)
    if heads is not None:
        swept = swept.unionByName(head_rows(heads, limits.stretch))
    swept = settle(swept)

    sums = ["n_children", "n_leaves", "saved"]
    parts = swept.where(F.col("kind") == KIND_PART).select("k1", "k2", *sums).unionByName(
        later_sums(swept.where(F.col("kind") == KIND_OWNED).select("conv_id", "stretch", "saved", "n_leaves"), rows, limits.stretch))
    parts = parts.groupBy("k1", "k2").agg(*[F.sum(c).alias(f"more_{c}") for c in sums])
    zero = F.lit(0).cast("long")
    root = convs.agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs")).where("n_convs > 0").select(
        zero.alias("k1"), zero.alias("k2"), zero.alias("depth"), "conv_id", "n_convs", zero.alias("n_children"), zero.alias("n_leaves"), zero.alias("saved"),
        *[F.lit(None).cast("long").alias(c) for c in ("parent_conv_id", "p1", "p2")])
    nodes = swept.where(F.col("kind") == KIND_NODE).select(*NODE, "parent_conv_id", "p1", "p2").unionByName(root)
    # The first nodes of later stretches learn their parent's smallest member here; the others know it.
    tops = nodes.where("p1 is not null and parent_conv_id is null").select(F.col("k1").alias("t1"), F.col("k2").alias("t2"), F.col("p1").alias("k1"), F.col("p2").alias("k2"))
    known = tops.join(nodes.select("k1", "k2", "conv_id"), ["k1", "k2"]).select(
        F.col("t1").alias("k1"), F.col("t2").alias("k2"), F.col("conv_id").alias("top_parent"))
    more = lambda c: F.col(c) + F.coalesce(f"more_{c}", F.lit(0))
    nodes = nodes.join(parts, ["k1", "k2"], "left").join(known, ["k1", "k2"], "left").join(ends(convs, rows, limits.block), ["k1", "k2"], "left")
    childless = more("n_children") == 0
    return nodes.select(
        "conv_id", "depth", F.coalesce("parent_conv_id", "top_parent").alias("parent_conv_id"), "n_convs", more("n_children").alias("n_children"),
        F.when(childless, F.lit(1)).otherwise(more("n_leaves")).cast("long").alias("n_leaves"), more("saved").alias("saved_tokens"),
        F.coalesce("ends_sha256", F.lit(hashlib.sha256(b"").hexdigest())).alias("ends_sha256"))
