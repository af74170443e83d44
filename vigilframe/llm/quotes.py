"""Quotation linking: nested quotes to the messages they quote, and conversations without quotes.

A message's lines carry a quote level (leading `>` marks). Every line, normalised, is a passage
known by a 64-bit hash; the latest earlier message of the conversation that holds it unquoted is
the original. Texts stay where they are: one pass turns each message into hashes and levels, which
meet in segments of consecutive turns. A pass over a segment's messages in order resolves what the
segment holds; what it leaves open meets the last turns of passages of earlier segments.
"""

from __future__ import annotations

import re
import string

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vigilframe.llm.words import settle

SEGMENT = 512  # turns of a conversation in one segment
ENDS = 4096  # passages in one row of a segment's last turns
MARKS = "^[ \\t]*((?:>[ \\t]?)*)"
BREAKS = "\r\n|\n|\r"
BLANKS = bytes.maketrans((string.punctuation + string.whitespace).encode(), b" " * len(string.punctuation + string.whitespace))
PLACE = ["conv", "no_conv", "segment"]  # no_conv: the conversation is null
SOURCES = "array<struct<source:bigint,votes:bigint,lines:bigint>>"


def passage_of(line: str) -> int | None:
    """Hash of a line in lower case, runs of white space and punctuation as one blank; null if nothing is left."""
    words = line.lower().encode().translate(BLANKS).split()
    return xxhash.xxh3_64_intdigest(b" ".join(words)) - (1 << 63) if words else None


def level_of(line: str) -> int:
    return re.match(MARKS, line)[1].count(">") if ">" in line else 0


def placed(messages: DataFrame) -> DataFrame:
    """Adds conv, no_conv, segment and mark; a message is known by conversation, turn and mark (hash of its text)."""
    kind = messages.schema["conv_id"].dataType
    return messages.select(
        "conv_id", F.col("turn").cast("long").alias("turn"), "role", "text",
        F.coalesce("conv_id", F.lit(0).cast(kind)).alias("conv"), F.col("conv_id").isNull().alias("no_conv"),
        F.floor(F.col("turn") / SEGMENT).alias("segment"), F.xxhash64("text").alias("mark"))


def parsed(messages: DataFrame, forms: tuple[str, ...] = ("",)) -> DataFrame:
    """(conv, no_conv, segment, turn, mark, passages, levels) of messages with a turn, by segment.

    levels has one list for each of `forms`: the lines' quote levels behind these marks. Repeats
    of a message within a batch of rows are left out before rows are sent.
    """
    rows = placed(messages).where("turn is not null").select(*PLACE, "turn", "mark", "text")
    kind = rows.schema["conv"].dataType.simpleString()

    def run(batches):
        for batch in batches:
            columns = [batch.column(i).to_pylist() for i in range(5)]
            seen, take, passages, levels = set(), [], [], []
            for i, (*key, text) in enumerate(zip(*columns, batch.column(5).to_pylist())):
                if tuple(key) in seen:
                    continue
                seen.add(tuple(key))
                lines = re.split(BREAKS, text) if text is not None else []
                take.append(i)
                passages.append([passage_of(line) for line in lines])
                levels.append([[level_of(form + line) for line in lines] for form in forms])
            kept = batch.select(range(5)).take(pa.array(take, pa.int64()))
            yield pa.RecordBatch.from_arrays(
                [*kept.columns, pa.array(passages, pa.list_(pa.int64())), pa.array(levels, pa.list_(pa.list_(pa.int32())))],
                names=[*PLACE, "turn", "mark", "passages", "levels"])

    return rows.mapInArrow(run, f"conv {kind}, no_conv boolean, segment long, turn long, mark long, passages array<long>, levels array<array<int>>"
                           ).repartition(*PLACE)


def lanes_of(messages: DataFrame) -> DataFrame:
    """Per segment: the last turn before it (null: none) and whether a later segment follows."""
    order = Window.partitionBy("conv", "no_conv").orderBy("segment")
    lanes = placed(messages).where("turn is not null").groupBy(*PLACE).agg(F.max("turn").alias("last"))
    return lanes.select(*PLACE, F.lag("last").over(order).alias("carried"), F.lead("segment").over(order).isNotNull().alias("later"))


def plain_lines(messages: DataFrame) -> DataFrame:
    return parsed(messages).select(*PLACE, "turn", "mark", "passages", F.col("levels")[0].alias("levels"))


def mail_lines(messages: DataFrame) -> DataFrame:
    """The lines of a mail thread made from a conversation: each message quotes the one before,
    which quotes the one before it.

    Derived input for linking, as the conversations come without quotes. What a message quotes is
    parsed behind its marks where it is written; hashes and levels alone move to the quoting message.
    """
    rows = parsed(messages, ("", "> ", ">> ")).dropDuplicates([*PLACE, "turn", "mark"])
    inside = Window.partitionBy(*PLACE)
    order = inside.orderBy("turn", "mark")
    rows = rows.withColumn("line", F.struct("passages", "levels")).select(
        *PLACE, "turn", "mark", "line", F.row_number().over(order).alias("n"), F.count("*").over(inside).alias("size"),
        F.lag("line").over(order).alias("one"), F.lag("line", 2).over(order).alias("two"))
    # The last two messages of a segment are quoted by the first two of the next: one row for each segment.
    tails = rows.where("n > size - 2").groupBy(*PLACE).agg(F.transform(F.array_sort(F.collect_list(F.struct("n", "line"))), lambda x: x["line"]).alias("tail"))
    across = Window.partitionBy("conv", "no_conv").orderBy("segment")
    none = F.array().cast(tails.schema["tail"].dataType)
    tails = tails.select(*PLACE, F.concat(F.coalesce(F.lag("tail", 2).over(across), none), F.coalesce(F.lag("tail").over(across), none)).alias("tail"))
    rows = rows.join(tails.where(F.size("tail") > 0), PLACE, "left")
    back = lambda k: F.get("tail", F.size("tail") - k)
    rows = rows.withColumns({
        "one": F.coalesce("one", F.when(F.col("n") == 1, back(1))),
        "two": F.coalesce("two", F.when(F.col("n") == 1, back(2)).when(F.col("n") == 2, back(1)))})
    parts = [("two", 2), ("one", 1), ("line", 0)]
    return rows.select(
        *PLACE, "turn", "mark",
        F.flatten(F.array(*[F.coalesce(F.col(c)["passages"], F.array().cast("array<bigint>")) for c, _ in parts])).alias("passages"),
        F.flatten(F.array(*[F.coalesce(F.col(c)["levels"][k], F.array().cast("array<int>")) for c, k in parts])).alias("levels"))


def resolved(lines: DataFrame, lanes: DataFrame) -> DataFrame:
    """One row per message: n_quoted, max_level, the turn before it, the sources of its quoted lines
    inside the segment, and the passages left open. Rows without a turn hold the last turns of a
    segment's passages, for later segments.
    """
    rows = lines.join(lanes, PLACE).select(*PLACE, "turn", "mark", "passages", "levels", "carried", "later").sortWithinPartitions(*PLACE, "turn", "mark")
    kind = rows.schema["conv"].dataType.simpleString()
    schema = (f"conv {kind}, no_conv boolean, segment long, turn long, mark long, n_quoted long, max_level int, before long, "
              f"sources {SOURCES}, open array<struct<passage:bigint,votes:bigint,lines:bigint>>, ends array<struct<passage:bigint,turn:bigint>>")

    def run(batches):
        place, message, follows = None, None, False
        said, fresh, turn, before = {}, set(), None, None  # fresh: passages of the turn at hand

        def ends():
            if follows:
                said.update(dict.fromkeys(fresh, turn))
                last = list(said.items())
                for i in range(0, len(last), ENDS):
                    yield (*place, None, None, None, None, None, None, None, last[i : i + ENDS])

        def rows_of(batch):
            nonlocal place, message, follows, said, fresh, turn, before
            for *at, now, mark, passages, levels, carried, later in zip(*(c.to_pylist() for c in batch.columns)):
                if at != place:
                    yield from ends()
                    place, message, follows, said, fresh, turn, before = at, None, later, {}, set(), None, carried
                if (now, mark) == message:
                    continue
                if message is not None and now != turn:
                    said.update(dict.fromkeys(fresh, turn))
                    fresh, before = set(), turn
                message, turn = (now, mark), now
                sources, open_ = {}, {}
                for passage, level in zip(passages, levels):
                    if passage is None:
                        continue
                    if level == 0:
                        fresh.add(passage)
                        continue
                    if passage in said:
                        tally = sources.setdefault(said[passage], [0, 0])
                    elif carried is not None:
                        tally = open_.setdefault(passage, [0, 0])
                    else:
                        continue
                    tally[0] += level == 1
                    tally[1] += 1
                yield (*place, now, mark, sum(v > 0 for v in levels), max(levels, default=0), before,
                       [(k, *v) for k, v in sources.items()], [(k, *v) for k, v in open_.items()], [])

        def packed(found):
            columns = list(zip(*found))
            three = lambda name: pa.list_(pa.struct([(name, pa.int64()), ("votes", pa.int64()), ("lines", pa.int64())]))
            kinds = [conv_kind, pa.bool_(), *[pa.int64()] * 4, pa.int32(), pa.int64(), three("source"), three("passage"),
                     pa.list_(pa.struct([("passage", pa.int64()), ("turn", pa.int64())]))]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=names)

        names = [*PLACE, "turn", "mark", "n_quoted", "max_level", "before", "sources", "open", "ends"]
        conv_kind = None
        for batch in batches:
            conv_kind = batch.schema.field(0).type
            if found := list(rows_of(batch)):
                yield packed(found)
        if place is not None and (found := list(ends())):
            yield packed(found)

    return rows.mapInArrow(run, schema)


def links_of(lines: DataFrame, lanes: DataFrame) -> DataFrame:
    """Per message (conv, no_conv, turn, mark): before, n_quoted, max_level and sources, earlier segments' included."""
    found = settle(resolved(lines, lanes))
    key = ["conv", "no_conv", "passage"]
    ends = found.where("turn is null").select(*PLACE, F.inline("ends").alias("passage", "last"))
    wanted = found.where(F.size("open") > 0).select(*PLACE, "turn", "mark", F.inline("open")).groupBy(*key, "segment").agg(
        F.collect_list(F.struct("turn", "mark", "votes", "lines")).alias("wanted"))  # of one segment
    both = ends.withColumn("wanted", F.lit(None).cast(wanted.schema["wanted"].dataType)).unionByName(
        wanted.withColumn("last", F.lit(None).cast("long"))).groupBy(*key, "segment").agg(F.max("last").alias("last"), F.first("wanted", True).alias("wanted"))
    earlier = Window.partitionBy(*key).orderBy("segment").rowsBetween(Window.unboundedPreceding, -1)
    far = both.withColumn("source", F.max("last").over(earlier)).where("source is not null").select("conv", "no_conv", "source", F.inline("wanted"))
    message = ["conv", "no_conv", "turn", "mark"]
    far = far.groupBy(*message, "source").agg(F.sum("votes").alias("votes"), F.sum("lines").alias("lines"))
    far = far.groupBy(*message).agg(F.collect_list(F.struct("source", "votes", "lines")).alias("far"))
    none = F.array().cast(SOURCES)
    return found.where("turn is not null").join(far, message, "left").select(
        *message, "before", "n_quoted", "max_level", F.concat("sources", F.coalesce("far", none)).alias("sources"))


def own_text(text: Column) -> Column:
    """The unquoted lines, without blanks before them."""
    bare = F.filter(F.split(text, BREAKS, -1), lambda line: ~line.rlike("^[ \\t]*>"))
    return F.trim(F.coalesce(F.array_join(F.transform(bare, lambda line: F.regexp_replace(line, "^[ \\t]+", "")), "\n"), F.lit("")), F.lit("\n "))


def linked_messages(messages: DataFrame, lines: DataFrame | None = None) -> DataFrame:
    """Every row of messages: role, reply_to, quoted_turns, n_quoted, n_linked, max_level and own text.

    reply_to is the turn most of the first-level quoted lines come from (of equal counts the
    latest); without a linked quote it is the turn before. quoted_turns lists all sources.
    own_text joins the unquoted lines. `lines` (plain_lines of messages, if not given) may add
    quotes. Rows that repeat (conv_id, turn) stay rows of their own; a later message links to what
    any of them says, none to another of the same turn. Null text: no lines, empty own text. A null
    conv_id is a conversation of its own; a row without a turn links nothing and has no reply_to.
    An empty table gives no rows. Other columns are not read.
    """
    rows = placed(messages)
    links = links_of(plain_lines(messages) if lines is None else lines, lanes_of(messages))
    with_turn = rows.where("turn is not null").select("conv_id", "role", "conv", "no_conv", "turn", "mark", own_text(F.col("text")).alias("own_text"))
    voted = F.filter("sources", lambda x: x["votes"] > 0)
    reply = F.array_max(F.transform(voted, lambda x: F.struct(x["votes"], x["source"])))["source"]
    with_turn = with_turn.join(links, ["conv", "no_conv", "turn", "mark"], "left").select(
        "conv_id", "turn", "role", F.coalesce(reply, "before").alias("reply_to"),
        F.array_join(F.array_sort(F.transform("sources", lambda x: x["source"])), ",").alias("quoted_turns"), "n_quoted",
        F.aggregate("sources", F.lit(0).cast("long"), lambda total, x: total + x["lines"]).alias("n_linked"), "max_level", "own_text")
    levels = F.transform(F.split("text", BREAKS, -1), lambda line: F.length(F.translate(F.regexp_extract(line, MARKS, 1), " \t", "")))
    levels = F.coalesce(levels, F.array().cast("array<int>"))
    without = rows.where("turn is null").withColumn("levels", levels).select(
        "conv_id", "turn", "role", F.lit(None).cast("long").alias("reply_to"), F.lit("").alias("quoted_turns"),
        F.size(F.filter("levels", lambda v: v > 0)).cast("long").alias("n_quoted"), F.lit(0).cast("long").alias("n_linked"),
        F.coalesce(F.array_max("levels"), F.lit(0)).alias("max_level"), own_text(F.col("text")).alias("own_text"))
    return with_turn.unionByName(without)


def matched(left: DataFrame, right: DataFrame, keys: list[str], how: str = "left") -> DataFrame:
    """left joined with right on keys that may be null."""
    right = right.select(*[F.col(k).alias(f"__{k}") for k in keys], *[c for c in right.columns if c not in keys])
    on = [F.col(k).eqNullSafe(F.col(f"__{k}")) for k in keys]
    return left.join(right, on, how).drop(*[f"__{k}" for k in keys])


def next_siblings(tree: DataFrame) -> DataFrame:
    """(conv_id, turn, sibling): the next turn with the same reply_to, by segments of turns; none for roots."""
    key = ["conv_id", "reply_to"]
    tree = tree.where("reply_to is not null").withColumn("lane", F.floor(F.col("turn") / SEGMENT))
    after = Window.partitionBy(*key).orderBy("lane").rowsBetween(1, Window.unboundedFollowing)
    lanes = tree.groupBy(*key, "lane").agg(F.min("turn").alias("least")).select(*key, "lane", F.min("least").over(after).alias("carried"))
    tree = tree.withColumn("near", F.lead("turn").over(Window.partitionBy(*key, "lane").orderBy("turn")))
    return matched(tree, lanes, [*key, "lane"]).select("conv_id", "turn", F.coalesce("near", "carried").alias("sibling"))


def conversations(linked: DataFrame) -> DataFrame:
    """linked_messages with root, depth and position, in the order of conv_id, root and position.

    root is the turn the chain of replies starts at and depth the number of replies to there.
    position counts the messages of a root from 0 as one reads a thread: each before its
    replies, replies to one message by turn, each followed by what answers it. Read in this order,
    own_text is the conversation without quotes. A row without a turn has no place: all three are
    null, and it comes first in its conversation. Rows that repeat a turn share its place, the latest reply_to counts.

    A walk around the tree enters and leaves every message; pointer doubling over its steps sums
    how many enterings are to come and how deep they are, in as many rounds as the walk's length has bits.
    """
    tree = settle(linked.where("turn is not null").groupBy("conv_id", "turn").agg(F.max("reply_to").alias("reply_to")))
    first = tree.where("reply_to is not null").groupBy("conv_id", F.col("reply_to").alias("turn")).agg(F.min("turn").alias("child"))
    nodes = matched(matched(tree, first, ["conv_id", "turn"]), next_siblings(tree), ["conv_id", "turn"])
    # A step is known by its turn and whether it leaves; to_turn and to_leave are the next step's.
    enter = nodes.select("conv_id", "turn", F.lit(0).alias("leave"), F.coalesce("child", "turn").alias("to_turn"),
                         F.col("child").isNull().cast("int").alias("to_leave"))
    leave = nodes.select("conv_id", "turn", F.lit(1).alias("leave"), F.coalesce("sibling", "reply_to").alias("to_turn"),
                         F.col("sibling").isNull().cast("int").alias("to_leave"))
    steps = settle(enter.unionByName(leave).select(
        "*", (1 - F.col("leave")).cast("long").alias("entered"), (1 - 2 * F.col("leave")).cast("long").alias("deeper"),
        F.when(F.col("to_turn").isNull(), F.col("turn")).alias("root")))
    while steps.where("to_turn is not null").limit(1).count():
        to = steps.select("conv_id", F.col("turn").alias("to_turn"), F.col("leave").alias("to_leave"), F.col("to_turn").alias("far_turn"),
                          F.col("to_leave").alias("far_leave"), F.col("entered").alias("more"), F.col("deeper").alias("down"), F.col("root").alias("far_root"))
        moved = matched(steps.where("to_turn is not null"), to, ["conv_id", "to_turn", "to_leave"], "inner").select(
            "conv_id", "turn", "leave", F.col("far_turn").alias("to_turn"), F.col("far_leave").alias("to_leave"),
            (F.col("entered") + F.col("more")).alias("entered"), (F.col("deeper") + F.col("down")).alias("deeper"), F.col("far_root").alias("root"))
        steps = settle(steps.where("to_turn is null").unionByName(moved))
    entered = steps.where("leave = 0")
    whole = entered.where("turn = root").select("conv_id", "root", F.col("entered").alias("whole"))
    placed = matched(entered, whole, ["conv_id", "root"]).select(
        "conv_id", "turn", "root", (-F.col("deeper")).alias("depth"), (F.col("whole") - F.col("entered")).alias("position"))
    return matched(linked, placed, ["conv_id", "turn"]).orderBy("conv_id", "root", "position")


def as_mail(messages: DataFrame) -> DataFrame:
    """Conversations as mail threads, written out: the texts whose lines mail_lines gives."""
    def quote(text, marks):
        return F.regexp_replace(text, "(?m)^", marks)

    key = ["conv_id", "lane"]
    order = Window.partitionBy(*key).orderBy("turn")
    placed = messages.select("conv_id", "turn", "role", "text", F.floor(F.col("turn") / SEGMENT).alias("lane"))
    placed = placed.withColumn("n", F.row_number().over(order)).select(
        "*", F.count("*").over(Window.partitionBy(*key)).alias("size"), F.lag("text").over(order).alias("one"), F.lag("text", 2).over(order).alias("two"))
    # The first two of a segment have theirs among the last two of earlier ones: a window over the segments' ends only.
    ends = placed.where("n <= 2 or n > size - 2")
    across = Window.partitionBy("conv_id").orderBy("lane", "n")
    ends = ends.withColumns({"one": F.lag("text").over(across), "two": F.lag("text", 2).over(across)}).where("n <= 2")
    return placed.where("n > 2").unionByName(ends).select(
        "conv_id", "turn", "role", F.concat_ws("\n", quote(F.col("two"), ">> "), quote(F.col("one"), "> "), "text").alias("text"))
