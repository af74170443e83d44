"""Exact Jaccard self-join of documents on word shingles, with signature trees.

1. Every text becomes a set of shingle hashes. Equal sets are one class from here on.
2. Classes of like size that share some of their rarest shingles are joined to candidate groups.
   The prefix of rarest shingles is so long that a pair at the threshold has several of them in
   common; a class with fewer shared ones is out. How frequent a shingle is comes from a table
   of counters of fixed size, so passages that many documents share link nothing.
3. In each candidate group, classes are ordered by size and form the leaves of a tree whose
   nodes hold OR-combined token bitmaps and size ranges. A dual traversal drops node pairs
   whose greatest possible overlap is too small; what is left is compared exactly. Groups too
   large for one task are cut by size range and hash into blocks, and each pair of blocks whose
   sizes can match is one task.
4. A task returns one row per class: its links and a spanning link, never all pairs.

A class is known by a 64-bit hash of its set.
"""

from __future__ import annotations

import math
from itertools import pairwise

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vigilframe.llm.components import components
from vigilframe.llm.words import (
    PART, STEP, byte_texts, counter_rows, scatter, settle, shingle_set, slices, summed_counts, unpacked, word_hashes, word_memo,
)
from vigilframe.session import fresh_path

SLOTS = 1 << 22  # counters of shingle frequency
FILTER_SLOTS = 1 << 20  # flags of documents whose sets are wanted
BITS = 2048  # bitmap of a tree node
LEAF, FAN = 16, 8
BLOCK_CLASSES, BLOCK_TOKENS = 1024, 1 << 20
MOST_SENT = 200_000  # classes a task remembers having sent


def set_hash(tokens: np.ndarray) -> int:
    """64-bit hash of a sorted set of hashes."""
    mixed = scatter(tokens + np.uint64(0x51ED270B))
    return int(scatter(np.array([mixed.sum(dtype=np.uint64) ^ np.uint64(len(tokens))], np.uint64)).view(np.int64)[0])


def least_overlap(n: int, num: int, den: int) -> int:
    """The fewest common tokens that a set of n tokens has with a partner; also its least size."""
    return -(-num * n // den)


def shared_least(n: int, num: int, den: int) -> int:
    """How many common tokens the prefixes of sets of n tokens are made to hold."""
    return 1 + (n - least_overlap(n, num, den) + 1) // 4


def prefix_length(n: int, num: int, den: int) -> int:
    """Two sets at the threshold, each cut to this many tokens of one order, have at least
    shared_least(the smaller's size) of them in common."""
    return n - least_overlap(n, num, den) + shared_least(n, num, den)


# ---------------------------------------------------------------- trees

class Tree:
    """Levels of nodes over rows sorted by size: bitmap, size range, and slack.

    Slack is the most of (size - bits set) below a node: tokens that share a bit with others.
    A row and a node have at most slack + popcount(bitmap & bitmap) tokens in common.
    """

    def __init__(self, sizes: np.ndarray, bitmaps: np.ndarray):
        slack = sizes - np.bitwise_count(bitmaps).sum(axis=1, dtype=np.int64)
        self.levels = [(bitmaps, sizes, sizes, slack)]
        width = LEAF
        while len(self.levels[-1][1]) > 1:
            maps, low, high, slack = self.levels[-1]
            starts = np.arange(0, len(low), width)
            self.levels.append((np.bitwise_or.reduceat(maps, starts), np.minimum.reduceat(low, starts),
                                np.maximum.reduceat(high, starts), np.maximum.reduceat(slack, starts)))
            width = FAN

    def children(self, level: int) -> tuple[int, int]:
        return (LEAF if level == 1 else FAN), len(self.levels[level - 1][1])


def may_match(a, b, i: np.ndarray, j: np.ndarray, num: int, den: int) -> np.ndarray:
    """Whether nodes i of level a and j of level b can hold a pair at the threshold."""
    out = np.zeros(len(i), bool)
    for at in range(0, len(i), 1 << 14):
        x, y = i[at : at + (1 << 14)], j[at : at + (1 << 14)]
        low_a, high_a, low_b, high_b = a[1][x], a[2][x], b[1][y], b[2][y]
        ok = (den * high_a >= num * low_b) & (den * high_b >= num * low_a)
        common = np.bitwise_count(a[0][x] & b[0][y]).sum(axis=1, dtype=np.int64)
        most = np.minimum(np.minimum(high_a, high_b), common + np.minimum(a[3][x], b[3][y]))
        out[at : at + (1 << 14)] = ok & ((num + den) * most >= num * (low_a + low_b))
    return out


def descend(tree_a: Tree, tree_b: Tree, same: bool, num: int, den: int):
    """Batches of row pairs (i, j) that the traversal of both trees can't drop; i < j if same."""
    stack = [(len(tree_a.levels) - 1, len(tree_b.levels) - 1, np.zeros(1, np.int64), np.zeros(1, np.int64))]
    while stack:
        la, lb, i, j = stack.pop()
        keep = may_match(tree_a.levels[la], tree_b.levels[lb], i, j, num, den)
        if same and la == lb:
            keep &= (i < j) if la == 0 else (i <= j)
        i, j = i[keep], j[keep]
        if not len(i):
            continue
        if la == 0 and lb == 0:
            yield i, j
            continue
        for at in range(0, len(i), 4096):
            x, y = i[at : at + 4096], j[at : at + 4096]
            down_a, down_b = la > 0 and la >= lb, lb > 0 and lb >= la
            if down_a:
                fan, count = tree_a.children(la)
                x, y = np.repeat(x * fan, fan) + np.tile(np.arange(fan), len(x)), np.repeat(y, fan)
                x, y = x[x < count], y[x < count]
            if down_b:
                fan, count = tree_b.children(lb)
                x, y = np.repeat(x, fan), np.repeat(y * fan, fan) + np.tile(np.arange(fan), len(y))
                x, y = x[y < count], y[y < count]
            stack.append((la - down_a, lb - down_b, x, y))


def overlaps(ids_a, at_a, ids_b, at_b, i, j, vocabulary: int) -> np.ndarray:
    """Common tokens of each row pair; rows are ranges of dense token numbers."""
    order = np.argsort(i, kind="stable")
    out = np.zeros(len(i), np.int64)
    flags = np.zeros(vocabulary, bool)
    rows, starts = np.unique(i[order], return_index=True)
    for row, (s, e) in zip(rows.tolist(), pairwise([*starts.tolist(), len(i)])):
        own = ids_a[at_a[row] : at_a[row + 1]]
        flags[own] = True
        for c in range(s, e, 512):
            spot = order[c : min(e, c + 512)]
            begin, size = at_b[j[spot]], at_b[j[spot] + 1] - at_b[j[spot]]
            ends = np.cumsum(size)
            reach = np.arange(ends[-1]) + np.repeat(begin - (ends - size), size)
            out[spot] = np.add.reduceat(flags[ids_b[reach]], ends - size, dtype=np.int64)
        flags[own] = False
    return out


def side_of(pdf: pd.DataFrame):
    """(classes, weights, sizes, bitmaps, tokens, offsets) of rows sorted by size."""
    pdf = pdf.drop_duplicates("cls")
    sets = [np.frombuffer(t, np.uint64) for t in pdf["tokens"]]
    order = sorted(range(len(sets)), key=lambda r: (len(sets[r]), int(sets[r][0])))
    sets = [sets[r] for r in order]
    sizes = np.array([len(s) for s in sets], np.int64)
    bitmaps = np.zeros((len(sets), BITS // 64), np.uint64)
    for r, s in enumerate(sets):
        bit = s >> np.uint64(53)
        np.bitwise_or.at(bitmaps[r], (bit >> np.uint64(6)).astype(np.int64), np.uint64(1) << (bit & np.uint64(63)))
    return (pdf["cls"].to_numpy()[order], pdf["weight"].to_numpy()[order], sizes, bitmaps,
            np.concatenate(sets), np.concatenate([[0], np.cumsum(sizes)]))


def link_block(pdf: pd.DataFrame, num: int, den: int) -> pd.DataFrame:
    """(cls, root, links) for the classes of one block, or of a pair of blocks, that have links."""
    same = bool((pdf["side"] == 2).all())
    if not same and not ((pdf["side"] == 1).any() and (pdf["side"] != 1).any()):  # a side that got no class by hash
        return pd.DataFrame({"cls": [], "root": [], "links": []}).astype("int64")
    left = side_of(pdf[pdf["side"] != 1])
    right = left if same else side_of(pdf[pdf["side"] == 1])
    vocabulary, ids = np.unique(np.concatenate([left[4]] if same else [left[4], right[4]]), return_inverse=True)
    ids_a, ids_b = ids[: len(left[4])], ids if same else ids[len(left[4]) :]
    shift = 0 if same else len(left[0])
    names = left[0] if same else np.concatenate([left[0], right[0]])
    links, parent = np.zeros(len(names), np.int64), list(range(len(names)))

    def find(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for i, j in descend(Tree(left[2], left[3]), Tree(right[2], right[3]), same, num, den):
        common = overlaps(ids_a, left[5], ids_b, right[5], i, j, len(vocabulary))
        linked = den * common >= num * (left[2][i] + right[2][j] - common)
        i, j = i[linked], j[linked]
        np.add.at(links, i, right[1][j])
        np.add.at(links, j + shift, left[1][i])
        for x, y in zip(i.tolist(), (j + shift).tolist()):
            x, y = find(x), find(y)
            if x != y:
                parent[max(x, y)] = min(x, y)
    at = np.flatnonzero(links)
    return pd.DataFrame({"cls": names[at], "root": names[[find(x) for x in at.tolist()]] if len(at) else names[at], "links": links[at]})


# ---------------------------------------------------------------- Spark stages

def shingled(docs: DataFrame, width: int) -> tuple[DataFrame, np.ndarray]:
    """(doc_id, n_shingles, cls) of every document, and the counters of shingle frequency."""

    def run(batches):
        memo, counts, pid = word_memo(), np.zeros(SLOTS, np.uint32), TaskContext.get().partitionId()

        def batch_of(rows):
            columns = list(zip(*rows)) or [[]] * 6
            kinds = [pa.int64()] * 3 + [pa.int32(), pa.int64(), pa.binary()]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)],
                                              names=["doc_id", "n_shingles", "cls", "part", "pid", "counts"])

        for batch in slices(batches):
            rows = []
            for doc, text in zip(batch.column(0).to_pylist(), byte_texts(batch.column(1))):
                tokens = shingle_set(word_hashes(text.lower(), memo), width)
                np.add.at(counts, (tokens & np.uint64(SLOTS - 1)).astype(np.int64), 1)
                rows.append((doc, len(tokens), set_hash(tokens) if len(tokens) else None, None, None, None))
            yield batch_of(rows)
        yield batch_of([(None, None, None, r["part"], r["pid"], r["counts"]) for r in counter_rows(pid, {0: counts})])

    out = settle(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(
        run, "doc_id long, n_shingles long, cls long, part int, pid long, counts binary"))
    counts = np.zeros(SLOTS, np.uint32)  # fixed size: SLOTS numbers come to the driver
    for r in summed_counts(out.where("part is not null").select("part", "pid", "counts"), ["part"]).collect():
        piece = unpacked(r["counts"])
        counts[r["part"] * PART : r["part"] * PART + len(piece)] = piece
    return out.where("part is null").select("doc_id", "n_shingles", "cls"), counts


def prefixes(docs: DataFrame, counts, width: int, num: int, den: int) -> DataFrame:
    """(token, cls, need): each document's rarest shingles, hashed together with its size band.

    A document whose partners may lie in the next band repeats its shingles there. need is how
    many of them a partner of any size must share.
    """
    step = 4 * math.log(den / num)

    def run(batches):
        memo, table = word_memo(), counts.value
        for batch in slices(batches):
            tokens, classes, needs = [np.empty(0, np.uint64)], [np.empty(0, np.int64)], [np.empty(0, np.int32)]
            for text in byte_texts(batch.column(0)):
                found = shingle_set(word_hashes(text.lower(), memo), width)
                n = len(found)
                if not n:
                    continue
                size = prefix_length(n, num, den)
                seen = table[(found & np.uint64(SLOTS - 1)).astype(np.int64)]
                if size < n:
                    limit = np.partition(seen, size - 1)[size - 1]
                    found_low = found[seen < limit]
                    kept = np.concatenate([found_low, found[seen == limit][: size - len(found_low)]])
                else:
                    kept = found
                own = math.floor(math.log(n) / step)
                above = math.floor((math.log(n) + step / 4 + 1e-9) / step)
                name = set_hash(found)
                for band in {own, above}:
                    tokens.append(scatter(kept + np.array([band], np.uint64) * STEP))
                    classes.append(np.full(size, name, np.int64))
                    needs.append(np.full(size, shared_least(least_overlap(n, num, den), num, den), np.int32))
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.concatenate(tokens).view(np.int64)), pa.array(np.concatenate(classes)), pa.array(np.concatenate(needs))],
                names=["token", "cls", "need"])

    return docs.select("text").mapInArrow(run, "token long, cls long, need int")


def wanted_sets(docs: DataFrame, flags, width: int) -> DataFrame:
    """(cls, tokens), once for each class, of the documents whose flag is set, and of those without an id.

    A task sends a class about once, so a text with many copies sends one set for each task.
    """
    slot = F.pmod(F.xxhash64(F.col("doc_id").cast("long")), F.lit(FILTER_SLOTS)).alias("slot")

    def run(batches):
        memo, table, sent = word_memo(), flags.value, set()
        for batch in slices(batches):
            slots = batch.column(0).to_numpy(zero_copy_only=False)
            picked = batch.column(1).filter(pa.array(table[slots]))
            sets = [shingle_set(word_hashes(t.lower(), memo), width) for t in byte_texts(picked)]
            fresh = {c: s for s in sets if len(s) and (c := set_hash(s)) not in sent}
            if len(sent) > MOST_SENT:
                sent.clear()
            sent.update(fresh)
            yield pa.RecordBatch.from_arrays(
                [pa.array(list(fresh), pa.int64()), pa.array([s.tobytes() for s in fresh.values()], pa.binary())],
                names=["cls", "tokens"])

    # Both parts of the aggregate combine; its shuffle is the one the join by class needs anyway.
    return docs.select(slot, "text").mapInArrow(run, "cls long, tokens binary").groupBy("cls").agg(F.first("tokens").alias("tokens"))


def blocks(candidates: DataFrame, num: int, den: int) -> DataFrame:
    """(cls, weight, block, side) for each task a class takes part in.

    A group of at most BLOCK_CLASSES classes and BLOCK_TOKENS tokens is one block. A larger one
    is cut into size ranges so wide that partners lie in the same or the next one, and these by
    hash. Side 2: the block is joined with itself; 0 and 1: the sides of a pair of blocks.
    """
    groups = candidates.groupBy("root").agg(F.count("*").alias("n"), F.sum("n_shingles").alias("t"))
    candidates = candidates.join(groups, "root")
    small = (F.col("n") <= BLOCK_CLASSES) & (F.col("t") <= BLOCK_TOKENS)
    one = candidates.where(small).select(
        "cls", "weight", F.concat_ws(":", F.lit("g"), "root").alias("block"), F.lit(2).alias("side"))

    step = math.log(den / num) * 1.0001
    large = candidates.where(~small).select("cls", "weight", "root", "n_shingles",
                                            F.floor(F.log("n_shingles") / step).cast("int").alias("band"))
    parts = large.groupBy("root", "band").agg(F.greatest(
        F.ceil(F.count("*") / BLOCK_CLASSES), F.ceil(F.sum("n_shingles") / BLOCK_TOKENS)).cast("int").alias("parts"))
    around = parts
    for name, by in (("above", 1), ("below", -1)):
        near = parts.select("root", (F.col("band") - by).alias("band"), F.col("parts").alias(name))
        around = around.join(near, ["root", "band"], "left")
    large = large.join(around, ["root", "band"]).withColumn("mine", F.pmod(F.xxhash64("cls"), F.col("parts")).cast("int"))

    def key(band, low, high):
        return F.concat_ws(":", F.lit("p"), "root", band, low, high)

    def upto(count):
        return F.when(count > 0, F.sequence(F.lit(0), count - 1)).otherwise(F.array().cast("array<int>"))

    inner = F.transform(upto(F.col("parts")), lambda k: F.struct(
        key(F.concat(F.col("band").cast("string"), F.lit("=")), F.least("mine", k), F.greatest("mine", k)).alias("block"),
        F.when(k == F.col("mine"), 2).when(k > F.col("mine"), 0).otherwise(1).alias("side")))
    up = F.transform(upto(F.coalesce("above", F.lit(0))), lambda k: F.struct(
        key(F.col("band").cast("string"), F.col("mine"), k).alias("block"), F.lit(0).alias("side")))
    down = F.transform(upto(F.coalesce("below", F.lit(0))), lambda k: F.struct(
        key((F.col("band") - 1).cast("string"), k, F.col("mine")).alias("block"), F.lit(1).alias("side")))
    many = large.select("cls", "weight", F.explode(F.concat(inner, up, down)).alias("b")).select("cls", "weight", "b.block", "b.side")
    return one.unionByName(many)


def linked_classes(docs: DataFrame, width: int, num: int, den: int) -> tuple[DataFrame, DataFrame]:
    """(doc_id, n_shingles, cls) of every document, and of every class of equal sets (cls, least_id,
    weight, n_shingles, root, links); root is null for a class that links with no other."""
    spark = docs.sparkSession
    marked, table = shingled(docs, width)
    classes = settle(marked.where("cls is not null").groupBy("cls").agg(
        F.min("doc_id").alias("least_id"), F.count("*").alias("weight"), F.first("n_shingles").alias("n_shingles")))

    path = fresh_path(spark, "prefixes")
    sent = spark.sparkContext.broadcast(table)
    prefixes(docs, sent, width, num, den).write.parquet(path)
    sent.destroy()  # the prefixes are written
    tokens = spark.read.schema("token long, cls long, need int").parquet(path)
    shared = tokens.groupBy("token").agg(F.min("cls").alias("u"), F.max("cls").alias("top")).where("u <> top").select("token", "u")
    near = settle(tokens.join(shared, "token").groupBy("cls", "u").agg(F.count("*").alias("n"), F.max("need").alias("need")))
    left = near.groupBy("cls").agg(F.sum("n").alias("n"), F.max("need").alias("need")).where("n >= need").select("cls")
    groups = components(near.join(left, "cls").select("u", F.col("cls").alias("v")))

    members = groups.select(F.col("node").alias("cls"), "root").join(left, "cls")
    several = members.groupBy("root").agg(F.count("*").alias("k")).where("k > 1").select("root")
    candidates = settle(members.join(several, "root").join(classes, "cls"))
    slot = F.pmod(F.xxhash64("least_id"), F.lit(FILTER_SLOTS)).alias("slot")
    flags = np.zeros(FILTER_SLOTS, bool)  # fixed size, as above; a full table only means that every set is made
    flags[[r["slot"] for r in candidates.select(slot).distinct().collect()]] = True
    sent = spark.sparkContext.broadcast(flags)
    sets = wanted_sets(docs, sent, width)
    found = (
        blocks(candidates, num, den).join(sets, "cls")
        .groupBy("block").applyInPandas(lambda pdf: link_block(pdf, num, den), "cls long, root long, links long")
    )
    found = settle(found)
    sent.destroy()
    roots = components(found.select(F.col("cls").alias("u"), F.col("root").alias("v")))
    links = found.groupBy("cls").agg(F.sum("links").alias("links"))

    return marked, classes.join(roots.withColumnRenamed("node", "cls"), "cls", "left").join(links, "cls", "left")


def linked_documents(docs: DataFrame, width: int = 5, num: int = 8, den: int = 10) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id, n_links.

    Two documents link when |A and B| / |A or B| >= num / den on their sets of lower-cased
    (A-Z) word shingles. component_id is the smallest doc_id that links reach; n_links counts
    the other documents linked with this one, exact copies included. Null or empty texts have
    no shingles, no links and their own id. Rows that repeat an id are documents of their own.
    A row without an id links like any other but names no component; if none of its component
    has an id, component_id is null. An empty table gives no rows. Other columns are not read.
    """
    marked, classes = linked_classes(docs, width, num, den)
    names = classes.where("root is not null").groupBy("root").agg(F.min("least_id").alias("name"))
    named = classes.join(names, "root", "left").select(
        "cls", F.coalesce("name", "least_id").alias("component_id"),
        (F.coalesce("links", F.lit(0)) + F.col("weight") - 1).alias("n_links"))
    return marked.join(named, "cls", "left").select(
        "doc_id", "n_shingles", F.when(F.col("cls").isNull(), F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"),
        F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"))


def with_class(docs: DataFrame, width: int) -> DataFrame:
    """docs with __cls and __spread. Rows without words have no class, but a number of their own in __spread.

    Of the rows of a slice of a batch with one id and class only the last by text stays.
    """
    names = docs.columns

    def run(batches):
        memo, n, pid = word_memo(), 0, TaskContext.get().partitionId()
        for batch in slices(batches):
            texts = batch.column(names.index("text"))
            ids = batch.column(len(names)).to_pylist()
            classes, spread, best = [], [], {}
            for row, (doc, text) in enumerate(zip(ids, byte_texts(texts))):
                tokens = shingle_set(word_hashes(text.lower(), memo), width)
                classes.append(set_hash(tokens) if len(tokens) else None)
                spread.append(0 if len(tokens) else (pid << 33) + n)
                n += 1
                at = (doc, classes[-1]) if len(tokens) else (row, None, None)
                if at not in best or text > best[at][0]:
                    best[at] = (text, row)
            kept = pa.array(sorted(row for _, row in best.values()), pa.int64())
            columns = [*batch.columns[: len(names)], pa.array(classes, pa.int64()), pa.array(spread, pa.int64())]
            yield pa.RecordBatch.from_arrays([c.take(kept) for c in columns], names=[*names, "__cls", "__spread"])

    kind = T.StructType([*docs.schema.fields, T.StructField("__cls", T.LongType()), T.StructField("__spread", T.LongType())])
    return docs.withColumn("__id", F.col("doc_id").cast("long")).mapInArrow(run, kind)


def one_of_each(docs: DataFrame, width: int = 5, num: int = 8, den: int = 10) -> DataFrame:
    """The rows of docs without near duplicates: of each component one row, that with the smallest id.

    All columns stay. Rows are judged by their texts, not by their ids: rows that repeat an id or
    have none stay if their texts are no near duplicates. A row without an id stays only where
    nothing in its component has one. Of rows with one id and set of shingles the last by text
    stays; of several sets with the smallest id that of the smallest hash. Texts without words are
    no duplicates of anything, so all these rows stay.
    """
    names = docs.columns
    # Other columns may have any name, so they go by their place.
    docs = docs.select(*[F.col("`" + n.replace("`", "``") + "`").alias(n if n in ("doc_id", "text") else f"c{i}") for i, n in enumerate(names)])
    _, classes = linked_classes(docs, width, num, den)
    first = F.min(F.struct(F.col("least_id").isNull().alias("none"), "least_id", "cls")).alias("first")
    kept = classes.groupBy(F.coalesce("root", "cls").alias("component")).agg(first).select(
        F.col("first.cls").alias("__kept"), F.col("first.least_id").alias("__id"))
    rows = with_class(docs, width)
    chosen = rows.join(kept, [
        F.coalesce("__cls", "__spread") == F.col("__kept"), F.col("__cls").isNotNull(), F.col("doc_id").cast("long").eqNullSafe(F.col("__id"))], "left")
    row = F.row_number().over(Window.partitionBy("__cls", "__spread", "__id").orderBy(F.col("text").desc_nulls_last()))
    return (
        chosen.where("__cls is null or __kept is not null").withColumn("__row", row)
        .where("__cls is null or __row = 1").select(*docs.columns).toDF(*names)
    )
