"""Chat formatting by quotation linking: DataFrame functions, and the reply order of each conversation's numbers in Python.

A line that begins with `>` marks is quoted; the number of marks is its level. Neighbouring lines of one level form a passage.
Passages are normalised (marks off, A-Z lower-cased, white space runs to one blank) and hashed. A quoted passage is joined to
the earlier message of its conversation that has it in its own words (level 0), or, if there is none, in a passage of a lower
level; among several the latest wins. To have it is to have its lines, all and in order, as neighbouring lines of one passage
(blank lines don't count), or its text, however broken into lines, as a whole passage, a paragraph or a line. If no message has
a quoted passage as a whole, the first of its paragraphs that one has stands for it. An excerpt that begins or ends within a line
of the original is not looked for. A message replies to what its first linked quote of the lowest level comes from, else to the
message before it. Conversations are written without quotes, every message after the one it replies to, siblings by turn.

A null or empty text is a message without content. Lines like "On ... wrote:" that introduce a quote go with it. Rows that are
equal in conv_id, turn, role and text count once; other messages of one turn are all kept, as siblings in the order of role and
text. None of them links to another by a quote, and what comes after them without a linked quote replies to the last one. A null
turn comes before all others. A message with a null conv_id is a conversation of its own. A message that quotes itself or a later
one isn't linked by that. Null roles are "user". Texts of any length are read whole. An empty table gives an empty result. Other
columns are not read, whatever their names.

A conversation is a unit: what is held of it in one task is 24 bytes a message.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lumaframe.session import ship_code

MARKS = r"^[ \t]*((?:>[ \t]?)*)"
INTRODUCES = r"(?i)^[ \t]*(on\b.{0,200}\bwrote:|.{1,80}\bwrote:)[ \t]*$"


def _level(line: Column) -> Column:
    return F.length(F.regexp_replace(F.regexp_extract(line, MARKS, 1), r"[^>]", ""))


def _normal(line: Column) -> Column:
    bare = F.regexp_replace(line, MARKS, "")
    low = F.translate(bare, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.trim(F.regexp_replace(low, r"\s+", " "))


def numbered(messages: DataFrame) -> DataFrame:
    """The different messages with c (conversation), n (from 1 in its order: turn, role, text; nulls first) and rank (the lowest n of its turn)."""
    alone = F.concat(F.lit("n"), F.sha2(F.to_json(F.struct("turn", "role", "text")), 256))
    keyed = messages.select(F.coalesce(F.concat(F.lit("c"), F.col("conv_id").cast("string")), alone).alias("c"), "conv_id", "turn", "role", "text")
    order = Window.partitionBy("c").orderBy("turn", "role", "text")
    row = F.struct("turn", "role", "text")
    again = F.coalesce(F.lag(row).over(order) == row, F.lit(False))
    keyed = keyed.withColumn("again", again).where("not again").withColumn("n", F.row_number().over(order))
    keyed = keyed.withColumn("rank", F.rank().over(Window.partitionBy("c").orderBy("turn")))
    return keyed.select("c", "n", "rank", "conv_id", "turn", F.coalesce("role", F.lit("user")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))


def passages(messages: DataFrame) -> DataFrame:
    """c, n, rank, at, level, paragraphs, lines, text: the passages of every message, in order; blank lines belong to none.

    lines is the normalised text, paragraphs the same in pieces between blank lines, with newlines between the lines of one.
    """
    lines = messages.select("c", "n", "rank", F.posexplode(F.split(F.coalesce("text", F.lit("")), r"\r?\n")).alias("at", "line"))
    lines = lines.select("c", "n", "rank", "at", "line", _level(F.col("line")).alias("level"), _normal(F.col("line")).alias("normal")).where("normal <> ''")
    order = Window.partitionBy("c", "n").orderBy("at")
    introduces = (F.col("level") == 0) & F.col("line").rlike(INTRODUCES) & (F.coalesce(F.lead("level").over(order), F.lit(0)) > 0)
    lines = lines.withColumn("intro", introduces).where("not intro")
    new = F.col("level") != F.coalesce(F.lag("level").over(order), F.lit(-1))
    # A normalised line is not empty and has no newline in it, so an empty one can stand for what was left out before it.
    lines = lines.withColumn("gap", ~new & (F.col("at") > F.lag("at").over(order) + 1)).withColumn("nth", F.sum(new.cast("int")).over(order))
    grouped = lines.groupBy("c", "n", "nth").agg(F.first("rank").alias("rank"), F.first("level").alias("level"), F.min("at").alias("at"), F.sort_array(F.collect_list(F.struct("at", "gap", "normal", "line"))).alias("x"))
    marked = F.array_join(F.transform("x", lambda e: F.concat(F.when(e["gap"], F.lit("\n")).otherwise(F.lit("")), e["normal"])), "\n")
    return grouped.select("c", "n", "rank", "at", "level", F.split(marked, "\n\n").alias("paragraphs"), F.col("x.normal").alias("lines"), F.array_join("x.line", "\n").alias("text"))


def _key(lines: Column | str) -> Column:
    """128 bits for a text, wherever its lines end."""
    text = F.translate(lines, "\n", " ")
    return F.struct(F.xxhash64(text).alias("h"), F.xxhash64(F.lit("2"), text).alias("h2"))


def links(found: DataFrame) -> DataFrame:
    """c, n, level, at, source: each quoted passage that an earlier message of the conversation has, and the latest such.

    A quoted passage is looked for as a whole (piece 0), then by its paragraphs in their order. What it can be found as are the
    passages, paragraphs, lines and runs of lines of the other messages, the runs of all sizes that quotes of the conversation have.
    """
    whole, parts = F.array(F.array_join("lines", "\n")), F.when(F.size("paragraphs") > 1, F.col("paragraphs")).otherwise(F.array().cast("array<string>"))
    pieces = found.where("level > 0").select("c", "n", "rank", "level", "at", F.posexplode(F.concat(whole, parts)).alias("piece", "text"))
    quotes = pieces.select("c", "n", "rank", "level", "at", "piece", _key("text").alias("k")).select("c", "n", "rank", "level", "at", "piece", "k.h", "k.h2")
    sizes = pieces.groupBy("c").agg(F.collect_set(F.size(F.split("text", "\n"))).alias("sizes"))
    fitting = F.filter(F.array_union("sizes", F.array(F.lit(1))), lambda n: n <= F.size("lines"))
    runs = F.flatten(F.transform(fitting, lambda n: F.transform(F.sequence(F.lit(1), F.size("lines") - n + 1), lambda i: _key(F.array_join(F.slice("lines", i, n), "\n")))))
    every = F.array_distinct(F.concat(F.transform(F.concat(whole, parts), _key), runs))
    own = found.join(sizes, "c").select("c", F.col("n").alias("source"), F.col("level").alias("there"), F.explode(every).alias("k")).select("c", "source", "there", "k.h", "k.h2")
    # A conversation is a bounded unit; texts of one hash within it are joined by all keys.
    joined = quotes.join(own, ["c", "h", "h2"]).where("source < rank and there < level")
    best = F.max(F.struct((-F.col("piece")).alias("piece"), (F.col("there") == 0).alias("first"), "source"))
    return joined.groupBy("c", "n", "level", "at").agg(best.getField("source").alias("source"))


def replies(messages: DataFrame) -> DataFrame:
    """c, n, conv_id, turn, role, content (without quotes), n_quotes, n_linked, parent: the n that it replies to."""
    unique = numbered(messages)
    found = passages(unique)
    linked = links(found).groupBy("c", "n").agg(F.count("*").alias("n_linked"), F.min(F.struct("level", "at", "source")).getField("source").alias("source"))
    own = found.groupBy("c", "n").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.when(F.col("level") == 0, F.struct("at", "text")))), lambda x: x["text"]), "\n").alias("content"), F.sum((F.col("level") > 0).cast("long")).alias("n_quotes"))
    before = F.when(F.col("rank") > 1, F.col("rank") - 1)
    return (
        unique.join(own, ["c", "n"], "left").join(linked, ["c", "n"], "left")
        .select("c", "n", "conv_id", "turn", "role", F.coalesce("content", F.lit("")).alias("content"), F.coalesce("n_quotes", F.lit(0)).alias("n_quotes"), F.coalesce("n_linked", F.lit(0)).alias("n_linked"), F.coalesce("source", before).alias("parent"))
    )


def preorder(parent: np.ndarray) -> np.ndarray:
    """Place of each message in reply order: after the one it replies to (an earlier one, -1 for none), siblings as they come."""
    n, above = len(parent), parent.tolist()
    size, place = [1] * n, [0] * n
    for i in range(n - 1, -1, -1):
        if above[i] >= 0:
            size[above[i]] += size[i]
    begin, free = 0, [0] * n  # where the next root, and the next reply to a message, goes
    for i, p in enumerate(above):
        if p < 0:
            place[i], begin = begin, begin + size[i]
        else:
            place[i], free[p] = free[p], free[p] + size[i]
        free[i] = place[i] + 1
    return np.array(place, np.int64)


def _ordered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """c, n, position, reply_to of rows (c, n, parent, turn) sorted by c and n; the numbers of one conversation are held, not its texts."""

    def placed(kept: list[pa.RecordBatch]) -> pa.RecordBatch:
        table = pa.Table.from_batches(kept).combine_chunks()
        parent = table["parent"].combine_chunks().fill_null(0).to_numpy().astype(np.int64) - 1
        answered = table["turn"].combine_chunks().take(pa.array(parent, mask=parent < 0))
        columns = [table["c"].combine_chunks(), table["n"].combine_chunks(), pa.array(preorder(parent)), answered]
        return pa.RecordBatch.from_arrays(columns, names=["c", "n", "position", "reply_to"])

    kept: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        begins = [0, *(i for i, n in enumerate(batch.column(1).to_numpy().tolist()) if n == 1 and i), batch.num_rows]
        for a, b in zip(begins, begins[1:], strict=False):
            part = batch.slice(a, b - a)
            if kept and part.column(1)[0].as_py() == 1:
                yield placed(kept)
                kept = []
            kept.append(part)
    if kept:
        yield placed(kept)


def conversations(messages: DataFrame) -> DataFrame:
    """The messages with reply_to (a turn) and position: the place (from 0) in the conversation's reply order, every message after what it replies to."""
    ship_code(messages.sparkSession)
    flat = replies(messages)
    turn = flat.schema["turn"].dataType.simpleString()
    rows = flat.select("c", "n", "parent", "turn").repartition("c").sortWithinPartitions("c", "n")
    places = rows.mapInArrow(_ordered, f"c string, n int, position long, reply_to {turn}")
    return flat.join(places, ["c", "n"]).select("conv_id", "turn", "position", "role", "content", "reply_to", "n_quotes", "n_linked")
