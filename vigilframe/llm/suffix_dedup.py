"""Removal of byte passages that occur elsewhere, exactly, with suffix arrays of shards.

A byte goes if some string of `window` bytes that covers it also starts at another place.

1. Every window is named by its anchor: the least hash of the `gram`-byte strings in it. Equal
   windows have equal anchors, so only windows whose anchor occurs twice can be repeated.
   Neighbouring windows with one anchor are a piece; where an anchor has one piece and occurs
   once in it, nothing more is done. A piece that occurs twice is repeated in all its windows.
2. The other pieces of one anchor meet in a shard of bounded size. It sorts their suffixes by
   Larsson-Sadakane refinement (ranks of 8 bytes, then doubled on unsorted groups only, until
   they cover a window) and walks the pieces side by side with Kasai's rule for the common
   prefix with the suffix before. Windows that share `window` bytes with it are repeated.
3. An anchor with more pieces than a shard takes is cut into several. Each hands on a sorted
   run of its different windows' digests; merging finds those of other shards by binary search.

No text is compared with all others; a passage that a third of all documents hold is one piece.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vigilframe.llm.words import MIX_A, STEP, byte_texts, scatter, settle
from vigilframe.session import fresh_path

WINDOW, GRAM = 400, 64
PIECE = 1 << 10  # windows of a piece
BLOCK = 1 << 20  # bytes hashed together
SHARD_BYTES, SHARD_PIECES = 1 << 20, 1 << 10
LANE = 1 << 17  # digests of one merge task
MOST_SENT = 200_000  # texts a task remembers having sent
BYTE = scatter(np.arange(1, 257, dtype=np.uint64))
PIECES = "text_key binary, anchor long, content long, start long, windows int, inner boolean"
RUN = np.dtype([("digest", "<u8"), ("content", "<i8"), ("offset", "<i4")])
EMPTY_SHA = hashlib.sha256(b"").hexdigest()


# ---------------------------------------------------------------- hashes of byte strings

def joined(h: np.ndarray, by: int) -> np.ndarray:
    """Hashes of the string at i followed by that at i + by."""
    out = (h[: max(0, len(h) - by)] * STEP) + h[by:]
    out ^= out >> np.uint64(32)
    out *= MIX_A
    out ^= out >> np.uint64(29)
    return out


def string_hashes(data: np.ndarray, width: int) -> np.ndarray:
    """Hashes of all strings of `width` bytes, by doubling."""
    h, span = BYTE[data], 1
    while 2 * span <= width:
        h, span = joined(h, span), 2 * span
    return joined(h, width - span) if span < width else h


def least(values: np.ndarray, width: int) -> np.ndarray:
    """Least of every `width` neighbours."""
    span = 1
    while 2 * span <= width:
        values, span = np.minimum(values[: max(0, len(values) - span)], values[span:]), 2 * span
    rest = width - span
    return np.minimum(values[: max(0, len(values) - rest)], values[rest:]) if rest else values


def piece_bounds(names: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(start, windows) of the runs of equal anchors, cut at PIECE."""
    starts = np.concatenate([[0], np.flatnonzero(names[1:] != names[:-1]) + 1])
    sizes = np.diff(np.concatenate([starts, [len(names)]]))
    if len(sizes) and sizes.max() > PIECE:
        parts = -(-sizes // PIECE)
        number = np.arange(parts.sum()) - np.repeat(np.cumsum(parts) - parts, parts)
        ends = np.repeat(starts + sizes, parts)
        starts = np.repeat(starts, parts) + PIECE * number
        sizes = np.minimum(PIECE, ends - starts)
    return starts, sizes


def pieces_of(texts: list[bytes], window: int, gram: int):
    """(number of the text, anchors, contents, starts, windows, inner) of each text, in blocks of bytes.

    inner: the anchor occurs more than once in the piece.
    """
    def emit(number, data, at, first, grams, names):
        starts, sizes = piece_bounds(names)
        found = list(zip(starts.tolist(), sizes.tolist()))
        contents = [xxhash.xxh3_64_intdigest(data[at + s : at + s + w + window - 1]) for s, w in found]
        inner = [np.count_nonzero(grams[s : s + w + window - gram] == names[s]) > 1 for s, w in found]
        return number, names[starts], np.array(contents, np.uint64), starts + first, sizes, np.array(inner)

    held, total = [], 0
    for number, text in [*enumerate(texts), (None, b"")]:
        if number is None or total + len(text) > BLOCK:  # what fits in a block is hashed at once
            if held:
                data = b"".join(t for _, t in held)
                grams, at = string_hashes(np.frombuffer(data, np.uint8), gram), 0
                names = least(grams, window - gram + 1)
                for n, t in held:
                    yield emit(n, data, at, 0, grams[at : at + len(t) - gram + 1], names[at : at + len(t) - window + 1])
                    at += len(t)
            held, total = [], 0
        if len(text) > BLOCK:
            for first in range(0, len(text) - window + 1, BLOCK):
                data = text[first : first + BLOCK + window - 1]
                grams = string_hashes(np.frombuffer(data, np.uint8), gram)
                yield emit(number, data, 0, first, grams, least(grams, window - gram + 1))
        elif len(text) >= window:
            held.append((number, text))
            total += len(text)


# ---------------------------------------------------------------- one shard

def packed_words(data: np.ndarray) -> np.ndarray:
    """The 8 bytes from each position on as one number in their order; zeros follow the end."""
    padded = np.concatenate([data, np.zeros(8, np.uint8)]).astype(np.uint64)
    out = np.zeros(len(data) + 1, np.uint64)
    for j in range(8):
        out |= padded[j : j + len(out)] << np.uint64(56 - 8 * j)
    return out


def suffix_array(data: np.ndarray, depth: int, words: np.ndarray) -> np.ndarray:
    """Positions in the order of their suffixes' first `depth` bytes (or more).

    A rank is the first slot of its group. Each round doubles the bytes that ranks stand for,
    by sorting only the groups of several suffixes by the rank of what follows.
    """
    n = len(data)
    order = np.argsort(words[:n], kind="stable")
    slots = np.arange(n)

    def starts_of(keys: np.ndarray) -> np.ndarray:
        fresh = np.concatenate([[True], keys[1:] != keys[:-1]])
        return np.maximum.accumulate(np.where(fresh, np.arange(len(keys)), 0))

    rank = np.empty(n, np.int64)
    rank[order] = starts_of(words[order])
    known, open_slots = 8, slots
    while known < depth:
        held = rank[order[open_slots]]
        several = np.zeros(len(held), bool)
        several[1:] = held[1:] == held[:-1]
        several[:-1] |= several[1:]
        open_slots, held = open_slots[several], held[several]
        if not len(open_slots):
            break
        at = order[open_slots]
        after = at + known
        follow = np.where(after < n, rank[np.minimum(after, n - 1)] + 1, 0)
        keys = (held << np.int64(32)) | follow
        by = np.argsort(keys, kind="stable")
        at, keys = at[by], keys[by]
        order[open_slots] = at
        rank[at] = open_slots[starts_of(keys)]
        known *= 2
    return order


def equal_bytes(words: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """How many of the 8 bytes at i and j agree before the first that differs."""
    x = words[i] ^ words[j]
    out = np.zeros(len(x), np.int64)
    for bits in range(0, 64, 8):
        out += x < (np.uint64(1) << np.uint64(bits))
    return out


def common_prefixes(begin: np.ndarray, sizes: np.ndarray, before: np.ndarray, slot: np.ndarray,
                    words: np.ndarray, far: np.ndarray, window: int, reach: int) -> np.ndarray:
    """Kasai: the common prefix (up to `window`) of each window with the one before it in order.

    All pieces take a step at a time. What a window shares with the one before it, the next one
    shares but for a byte, if what follows the other is a window and comes before it too; only
    what is beyond is compared. (As suffixes are ordered by a bounded depth, it may come after.)
    """
    out = np.zeros(len(slot), np.int64)
    by_size = np.argsort(-sizes, kind="stable")
    begin, sizes = begin[by_size], sizes[by_size]
    carried = np.zeros(len(begin), np.int64)
    last = len(words) - 1
    for step in range(int(sizes[0])):
        active = int(np.searchsorted(-sizes, -step, side="left"))
        i = begin[:active] + step
        j = before[i]
        h = carried[:active]
        todo = np.flatnonzero((j >= 0) & (h < window))
        while len(todo):  # strides of `reach` bytes by their hashes
            a, b = i[todo] + h[todo], j[todo] + h[todo]
            inside = (h[todo] + reach <= window)
            same = np.zeros(len(todo), bool)
            same[inside] = far[a[inside]] == far[b[inside]]
            todo = todo[same]
            h[todo] += reach
        todo = np.flatnonzero((j >= 0) & (h < window))
        while len(todo):
            a, b = np.minimum(i[todo] + h[todo], last), np.minimum(j[todo] + h[todo], last)
            got = equal_bytes(words, a, b)
            h[todo] += got
            todo = todo[(got == 8) & (h[todo] < window)]
        h[j < 0] = 0
        np.minimum(h, window, out=h)
        out[i] = h
        other = slot[j + 1]
        carried = np.where((j >= 0) & (h > 0) & (other >= 0) & (other < slot[i + 1]), h - 1, 0)
    return out


def shard_order(pieces: list[bytes], window: int, gram: int = GRAM):
    """(sorted window positions, common prefix with the one before, first position and windows of each piece, data)."""
    data = np.frombuffer(b"".join(pieces), np.uint8)
    lengths = np.array([len(p) for p in pieces], np.int64)
    begin, sizes = np.cumsum(lengths) - lengths, lengths - window + 1
    valid = np.zeros(len(data) + 1, bool)
    marks = np.zeros(len(data) + 2, np.int64)
    np.add.at(marks, begin, 1)
    np.subtract.at(marks, begin + sizes, 1)
    valid[:] = marks.cumsum()[: len(valid)] > 0
    words = packed_words(data)
    order = suffix_array(data, window, words)
    order = order[valid[order]]
    before = np.full(len(data) + 1, -1, np.int64)
    before[order[1:]] = order[:-1]
    slot = np.full(len(data) + 1, -1, np.int64)
    slot[order] = np.arange(len(order))
    shared = common_prefixes(begin, sizes, before, slot, words, string_hashes(data, gram), window, gram)
    return order, shared[order], begin, sizes, data


def runs_of(flags: np.ndarray) -> np.ndarray:
    """(from, to) of the runs of true flags."""
    edges = np.flatnonzero(np.diff(np.concatenate([[0], flags.astype(np.int8), [0]])))
    return edges.reshape(-1, 2).astype("<i4")


FOUND = "kind int, anchor long, lane long, content long, data binary"


def dedup_shard(pdf: pd.DataFrame, window: int, gram: int) -> pd.DataFrame:
    """Repeated windows of a shard's pieces (kind 0) and, for an anchor cut into shards, runs of digests (kind 1)."""
    pdf = pdf.drop_duplicates(["anchor", "content"])
    order, shared, begin, sizes, data = shard_order(list(pdf["data"]), window, gram)
    again = shared >= window
    repeated = np.zeros(len(data) + 1, bool)
    repeated[order[again]] = True
    repeated[order[:-1][again[1:]]] = True
    names, contents, lanes = pdf["anchor"].tolist(), pdf["content"].tolist(), int(pdf["lanes"].iloc[0])
    rows = []
    for k, (b, s, alone) in enumerate(zip(begin.tolist(), sizes.tolist(), pdf["alone"].tolist())):
        if alone and repeated[b : b + s].any():
            rows.append((0, names[k], 0, contents[k], runs_of(repeated[b : b + s]).tobytes()))
    if lanes:
        heads = order[~again]
        piece = np.searchsorted(begin, heads, side="right") - 1
        run = np.empty(len(heads), RUN)
        run["digest"], run["content"] = string_hashes(data, window)[heads], np.array(contents, np.int64)[piece]
        run["offset"] = heads - begin[piece]
        run = run[np.argsort(run["digest"], kind="stable")]
        lane = run["digest"] % np.uint64(lanes)
        for x in np.unique(lane).tolist():
            rows.append((1, names[0], x, 0, run[lane == x].tobytes()))
    columns = list(zip(*rows)) or [[]] * 5
    return pd.DataFrame(dict(zip(["kind", "anchor", "lane", "content", "data"], columns))).astype(
        {"kind": "int32", "anchor": "int64", "lane": "int64", "content": "int64", "data": "object"})


def merge_runs(pdf: pd.DataFrame) -> pd.DataFrame:
    """Windows whose digest another shard's run holds too, found by binary search."""
    runs = [np.frombuffer(d, RUN) for d in pdf["data"]]
    everything = np.sort(np.concatenate([r["digest"] for r in runs]))
    hits = []
    for run in runs:
        low = np.searchsorted(everything, run["digest"], side="left")
        high = np.searchsorted(everything, run["digest"], side="right")
        hits.append(run[high - low > 1])
    hit = np.concatenate(hits)
    hit = hit[np.lexsort((hit["offset"], hit["content"]))]
    rows = []
    for content, start, end in group_bounds(hit["content"]):
        flags = np.zeros(PIECE, bool)
        flags[hit["offset"][start:end]] = True
        rows.append((pdf["anchor"].iloc[0], content, runs_of(flags).tobytes()))
    return pd.DataFrame(rows, columns=["anchor", "content", "data"]).astype({"anchor": "int64", "content": "int64", "data": "object"})


def group_bounds(keys: np.ndarray):
    if not len(keys):
        return
    starts = np.concatenate([[0], np.flatnonzero(keys[1:] != keys[:-1]) + 1, [len(keys)]])
    yield from zip(keys[starts[:-1]].tolist(), starts[:-1].tolist(), starts[1:].tolist())


# ---------------------------------------------------------------- Spark stages

def digest_of(text: bytes) -> bytes:
    return xxhash.xxh3_128_digest(text)


def once(batches, window: int):
    """(digests, texts) of the texts that hold a window, each about once for each task."""
    sent: set[bytes] = set()
    for batch in batches:
        fresh = {}
        for text in byte_texts(batch.column(0)):
            if len(text) >= window and (key := digest_of(text)) not in sent:
                fresh[key] = text
        if len(sent) > MOST_SENT:
            sent.clear()
        sent.update(fresh)
        yield list(fresh), list(fresh.values())


def pieces(docs: DataFrame, window: int, gram: int) -> DataFrame:
    def run(batches):
        for keys, texts in once(batches, window):
            out = [(np.empty(0, object), *[np.empty(0, np.int64)] * 4, np.empty(0, bool))]
            for number, names, contents, starts, sizes, inner in pieces_of(texts, window, gram):
                key = np.array([keys[number]] * len(names), object)  # np.full would strip the zero bytes at a digest's end
                out.append((key, names.view(np.int64), contents.view(np.int64), starts, sizes, inner))
            columns = [np.concatenate(c) for c in zip(*out)]
            kinds = [pa.binary(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.bool_()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)],
                                             names=["text_key", "anchor", "content", "start", "windows", "inner"])

    return docs.select("text").mapInArrow(run, PIECES)


def text_rows(docs: DataFrame, window: int) -> DataFrame:
    """(text_key, text), about once for each task and text."""
    def run(batches):
        for keys, texts in once(batches, window):
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), pa.array(texts, pa.binary())], names=["text_key", "data"])

    return docs.select("text").mapInArrow(run, "text_key binary, data binary")


def cut_pieces(texts: DataFrame, wanted: DataFrame, window: int) -> DataFrame:
    """The bytes of the wanted pieces; the list of a text is no longer than the text."""
    lists = wanted.groupBy("text_key").agg(F.collect_list(F.struct(
        "anchor", "content", "start", "windows", "shard", "part", "lanes", "alone")).alias("pieces"))

    def run(batches):
        for batch in batches:
            rows = [(p["shard"], p["part"], p["anchor"], p["content"], p["lanes"], p["alone"], text[p["start"] : p["start"] + p["windows"] + window - 1])
                    for text, found in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()) for p in found]
            kinds = [pa.int64()] * 5 + [pa.bool_(), pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(list(zip(*rows)) or [[]] * 7, kinds)],
                                             names=["shard", "part", "anchor", "content", "lanes", "alone", "data"])

    return texts.join(lists, "text_key").select("data", "pieces").mapInArrow(
        run, "shard long, part long, anchor long, content long, lanes long, alone boolean, data binary")


def repeated_windows(docs: DataFrame, window: int, gram: int) -> DataFrame:
    """(text_key, start, windows, data): pieces with repeated windows; data holds their runs, null is all."""
    spark = docs.sparkSession
    path = fresh_path(spark, "pieces")
    pieces(docs, window, gram).write.parquet(path)
    everywhere = spark.read.schema(PIECES).parquet(path)
    # Settled, so that the join has plain shuffles on both sides, which adaptive execution splits where an anchor is hot.
    twice = settle(everywhere.groupBy("anchor").agg(F.count("*").alias("times"), F.max("inner").alias("inner")).where("times > 1 or inner").select("anchor"))
    places = settle(everywhere.join(twice, "anchor"))

    place = F.struct("text_key", "start", "windows")
    kinds = settle(places.groupBy("anchor", "content").agg(
        F.count("*").alias("times"), F.min(place).alias("place"), F.max("inner").alias("inner")))
    held = F.col("place.windows") + F.lit(window - 1)
    # Only an anchor with a piece that occurs once has windows that are still to be judged.
    several = settle(kinds.groupBy("anchor").agg(
        F.count("*").alias("kinds"), F.sum(held).alias("bytes"), F.max("inner").alias("inner"), F.min("times").alias("least"),
    ).where("least = 1 and (kinds > 1 or inner)"))
    total = several.agg(F.coalesce(F.sum("bytes"), F.lit(0))).scalar()
    shards = F.greatest(F.lit(1), F.ceil(total / F.lit(SHARD_BYTES))).cast("long")
    parts = F.greatest(F.ceil(F.col("kinds") / SHARD_PIECES), F.ceil(F.col("bytes") / SHARD_BYTES)).cast("long")
    split = F.col("parts") > 1
    wanted = kinds.drop("inner").join(several.withColumn("parts", parts), "anchor").select(
        "anchor", "content", "place.*", (F.col("times") == 1).alias("alone"),
        F.when(split, F.col("anchor")).otherwise(F.pmod(F.xxhash64("anchor"), shards)).alias("shard"),
        F.when(split, F.pmod(F.xxhash64("content"), F.col("parts"))).otherwise(F.lit(-1)).cast("long").alias("part"),
        F.when(split, F.ceil(F.col("bytes") / LANE)).otherwise(F.lit(0)).cast("long").alias("lanes"))
    found = settle(
        cut_pieces(text_rows(docs, window), wanted, window)
        .groupBy("shard", "part").applyInPandas(lambda pdf: dedup_shard(pdf, window, gram), FOUND))
    merged = found.where("kind = 1").groupBy("anchor", "lane").applyInPandas(merge_runs, "anchor long, content long, data binary")
    whole = kinds.where("times > 1").select("anchor", "content", F.lit(None).cast("binary").alias("data"))
    some = found.where("kind = 0").select("anchor", "content", "data").unionByName(merged)
    flags = whole.unionByName(some)
    return places.join(flags, ["anchor", "content"]).select("text_key", "start", "windows", "data")


def cleaned(text: bytes, found: list[dict], window: int) -> tuple[int, int, str]:
    """(bytes removed, spans, digest of the rest) of a text with repeated windows."""
    runs = [np.array([[0, p["windows"]]]) if p["data"] is None else np.frombuffer(p["data"], "<i4").reshape(-1, 2) for p in found]
    bounds = np.concatenate([r.astype(np.int64) + p["start"] for r, p in zip(runs, found)])
    bounds = bounds[np.argsort(bounds[:, 0], kind="stable")]
    starts, ends = bounds[:, 0], np.maximum.accumulate(bounds[:, 1] + window - 1)
    fresh = np.concatenate([[True], starts[1:] > ends[:-1]])
    starts, ends = starts[fresh], ends[np.concatenate([np.flatnonzero(fresh)[1:] - 1, [len(ends) - 1]])]
    rest, at = hashlib.sha256(), 0
    for s, e in zip(starts.tolist(), ends.tolist()):
        rest.update(text[at:s])
        at = e
    rest.update(text[at:])
    return int((ends - starts).sum()), len(starts), rest.hexdigest()


def cleaned_texts(docs: DataFrame, windows: DataFrame, window: int) -> DataFrame:
    """(text_key, n_removed, n_spans, kept_sha256) of the texts that lose bytes."""
    lists = windows.groupBy("text_key").agg(F.collect_list(F.struct("start", "windows", "data")).alias("found"))

    def run(batches):
        for batch in batches:
            rows = [(key, *cleaned(text, found, window)) for key, text, found in zip(*[c.to_pylist() for c in batch.columns])]
            kinds = [pa.binary(), pa.int64(), pa.int64(), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(list(zip(*rows)) or [[]] * 4, kinds)],
                                             names=["text_key", "n_removed", "n_spans", "kept_sha256"])

    return text_rows(docs, window).join(lists, "text_key").select("text_key", "data", "found").mapInArrow(
        run, "text_key binary, n_removed long, n_spans long, kept_sha256 string")


def digests(docs: DataFrame) -> DataFrame:
    """(doc_id, text_key, n_bytes, sha256) of every row."""
    def run(batches):
        for batch in batches:
            texts = byte_texts(batch.column(1))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([digest_of(t) for t in texts], pa.binary()), pa.array([len(t) for t in texts], pa.int64()),
                 pa.array([hashlib.sha256(t).hexdigest() for t in texts], pa.string())],
                names=["doc_id", "text_key", "n_bytes", "sha256"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(
        run, "doc_id long, text_key binary, n_bytes long, sha256 string")


def deduplicated(docs: DataFrame, window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """One row per document: doc_id, n_bytes, n_removed, n_spans, kept_sha256.

    Texts count as UTF-8 bytes; matches don't cross documents, and both places of a match lose
    it. Null text is empty. A text shorter than `window` bytes keeps all; of equal texts with a
    window or more nothing is left. Every row is a document of its own, also without an id or
    with one that others have. An empty table gives no rows. Other columns are not read.
    `gram` is at most `window`.
    """
    rows = digests(docs)
    copies = rows.where(F.col("n_bytes") >= window).groupBy("text_key").agg(F.count("*").alias("times"), F.max("n_bytes").alias("n")).where("times > 1").select(
        "text_key", F.col("n").alias("n_removed"), F.lit(1).cast("long").alias("n_spans"), F.lit(EMPTY_SHA).alias("kept_sha256"))
    # A copied text is gone whole, which is also the most that its pieces can show.
    most = F.max_by(F.struct("n_spans", "kept_sha256"), "n_removed").alias("most")
    lost = cleaned_texts(docs, repeated_windows(docs, window, gram), window).unionByName(copies).groupBy("text_key").agg(
        F.max("n_removed").alias("n_removed"), most)
    return rows.join(lost, "text_key", "left").select(
        "doc_id", "n_bytes", F.coalesce("n_removed", F.lit(0)).cast("long").alias("n_removed"),
        F.coalesce("most.n_spans", F.lit(0)).cast("long").alias("n_spans"),
        F.coalesce("most.kept_sha256", "sha256").alias("kept_sha256"))
