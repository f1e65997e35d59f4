"""N-gram Jaccard self-join by filters in several global token orders.

A document's set is its distinct 5-word shingles, as 64-bit hashes (tokens). If two sets of sizes n and m have a Jaccard
similarity of t or more, then in any one order of all tokens their prefixes of n - ceil(t n) + 1 and m - ceil(t m) + 1 tokens
share a token, and so many that what follows the prefixes can make up the rest. All orders here put tokens first that few
documents have, by their exact counts over the whole corpus, and break ties by another hash each. So a token that only one
document has comes before all others: it can't be shared, and a document whose prefix has no others is in no pair at all.
Candidates share a prefix token in the first order at a position that still allows the overlap; then their prefixes must share
enough in all orders; then the sets are compared exactly, by the tokens that other documents have as well. Where a run's
documents are compared with each other, a bitmap of a set's tokens bounds the overlap before a pair is formed at all.

1. Counts. A task joins its documents' tokens into sorted blocks, cuts these by ranges of the token space (parts) and sends them
   packed (differences of sorted tokens), one row for each block and part. Equal sets of a block are sent once, a token that
   many of its documents have as one count. Each part counts its tokens and sends back those that came twice or more.
2. Links are only needed up to connection, so groups of any size take few comparisons. Equal sets are linked by their digests.
   In each prefix token's run, sorted by doc_id, every document is compared with the run's first if it shares enough such runs
   with it.
3. While that leaves much to compare, the documents outside their run's largest component are compared with a few others of
   its members, drawn anew each turn, so most of a group of near copies becomes one component in linear work.
4. The documents of a run that are still in different components are compared with each other, every pair that passes the
   filters (the run's token may be the first that they share); a pair whose components are one needs no comparison, and no
   link between others is lost.

Null texts and texts without words have an empty set and link with nothing. Repeated rows (equal doc_id) count once by their
set each and share their doc_id's component. An empty table gives an empty result. Texts of any length are read whole. Other
columns are not read, whatever their names. A null doc_id gets 0 and a null component.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lumaframe.llm.components import connected_components
from lumaframe.llm.words import mix, shingles, tidy
from lumaframe.session import Scratch, ship_code, stage

ORDERS = 3
#: A block ends with the document that gives it so many tokens or rows; a part has the tokens of about so many bytes of text.
BLOCK_TOKENS, BLOCK_ROWS, PART_BYTES = 1 << 20, 60_000, 12_000_000
#: A token that more documents of a block have is sent to its part as one count; the block keeps whose it is.
HOT_OWNERS = 512
_MANY = 0xFFFF  # stands for such owners
#: A token's run is dealt out over 2 ** (log2 of its count - SALT_BITS) sub-runs if that is more than one.
SALT_BITS = 8
#: Members of a run's largest component that one of the others is compared with in a turn, and the pairs for each row of mixed
#: runs beyond which there is another turn before all pairs between components are compared.
HUBS, WORK_A_ROW = 8, 4
#: Longs of a set's bitmap; a token sets one bit of it.
BITMAP = 16


# --- token counts


def packed(tokens: np.ndarray, owners: np.ndarray, base: int) -> bytes:
    """Sorted tokens from base on, and a 16-bit number for each."""
    steps = np.diff(tokens, prepend=np.uint64(base))
    width = max(1, (int(steps.max()).bit_length() + 7) // 8) if len(steps) else 1
    planes = steps.view(np.uint8).reshape(-1, 8)[:, :width].T.tobytes() + owners.astype("<u2").view(np.uint8).reshape(-1, 2).T.tobytes()
    return bytes([width]) + zstandard.compress(planes, 1)


def unpacked(body: bytes, base: int) -> tuple[np.ndarray, np.ndarray]:
    width, raw = body[0], np.frombuffer(zstandard.decompress(body[1:]), np.uint8)
    n = len(raw) // (width + 2)
    steps = np.zeros((n, 8), np.uint8)
    steps[:, :width] = raw[: width * n].reshape(width, n).T
    owners = np.ascontiguousarray(raw[width * n :].reshape(2, n).T).view("<u2").ravel()
    return np.uint64(base) + np.cumsum(steps.view("<u8").ravel(), dtype=np.uint64), owners


def _part_size(parts: int) -> int:
    return -(-(1 << 64) // parts)


class _Block:
    """The documents of a block: distinct sets' tokens, and for each row which set it has."""

    def __init__(self, most_tokens: int, most_rows: int) -> None:
        self.most_tokens, self.most_rows = most_tokens, most_rows
        self.ids: list[int] = []
        self.sizes: list[int] = []
        self.digests: list[int] = []
        self.first: list[int] = []  # the first row with the same set
        self.sets: list[np.ndarray] = []
        self.known: dict[int, int] = {}
        self.tokens = 0

    def add(self, doc: int, tokens: np.ndarray) -> bool:
        """Adds a row; whether the block is full then."""
        digest = xxhash.xxh3_128_intdigest(tokens.tobytes())
        row = self.known.setdefault(digest, len(self.ids)) if len(tokens) else len(self.ids)  # empty sets link with nothing
        if row == len(self.ids) and len(tokens):
            self.sets.append(tokens)
            self.tokens += len(tokens)
        self.ids.append(doc)
        self.sizes.append(len(tokens))
        self.digests.append(digest)
        self.first.append(row)
        return self.tokens >= self.most_tokens or len(self.ids) >= self.most_rows

    def rows(self, parts: int, salt: int, hot_owners: int) -> Iterator[tuple[int, int, int, bytes, bytes]]:
        """(block, part, kind, body, more): kind 0 for a part's tokens, 1 for what is known of the block's rows."""
        tokens = np.concatenate(self.sets) if self.sets else np.empty(0, np.uint64)
        owners = np.repeat(np.arange(len(self.sets), dtype=np.uint16), [len(s) for s in self.sets])
        order = np.argsort(tokens)
        tokens, owners = tokens[order], owners[order]
        start = np.flatnonzero(np.append(True, tokens[1:] != tokens[:-1])) if len(tokens) else np.empty(0, np.int64)
        count = np.diff(np.append(start, len(tokens)))
        hot = np.repeat(count > hot_owners, count)
        many, weights = start[count > hot_owners], count[count > hot_owners]
        kept = {"tokens": tokens[hot], "owners": owners[hot]}
        owners[many] = _MANY
        hot[many] = False
        tokens, owners = tokens[~hot], owners[~hot]
        size = _part_size(parts)
        cuts = np.searchsorted(tokens, np.arange(1, parts, dtype=np.uint64) * np.uint64(size)) if parts > 1 else []
        cuts = [0, *map(int, cuts), len(tokens)]
        full = [p for p in range(parts) if cuts[p] < cuts[p + 1]]
        known = {"ids": np.array(self.ids, np.int64), "sizes": np.array(self.sizes, np.int32), "first": np.array(self.first, np.int32), "digests": self.digests, "hot": kept, "parts": len(full)}
        raw = pickle.dumps(known)
        block = xxhash.xxh3_64_intdigest(raw, seed=salt) - (1 << 63)
        given = 0
        for p in full:
            a, b = cuts[p], cuts[p + 1]
            n = int((owners[a:b] == _MANY).sum())
            yield block, p, 0, packed(tokens[a:b], owners[a:b], p * size), weights[given : given + n].astype("<u4").tobytes()
            given += n
        yield block, block % parts, 1, zstandard.compress(raw, 1), b""


_BLOCKS = pa.schema([("block", pa.int64()), ("part", pa.int32()), ("kind", pa.int32()), ("body", pa.binary()), ("more", pa.binary())])
_BLOCK_FIELDS = "block long, part int, kind int, body binary, more binary"


def _sent(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*rows, strict=True), _BLOCKS, strict=True)], schema=_BLOCKS)


def _blocks(docs: DataFrame, parts: int) -> DataFrame:
    """The documents (doc_id, text) as rows of blocks and parts."""
    limits, hot_owners = (BLOCK_TOKENS, BLOCK_ROWS), HOT_OWNERS

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, n, task = _Block(*limits), 0, TaskContext.get().partitionId()
        for batch in batches:
            for doc, text in zip(batch.column(0), batch.column(1), strict=True):
                if block.add(doc.as_py(), shingles(text.as_py())):
                    yield _sent(list(block.rows(parts, (task << 32) + n, hot_owners)))
                    block, n = _Block(*limits), n + 1
        if block.ids:
            yield _sent(list(block.rows(parts, (task << 32) + n, hot_owners)))

    return docs.select("doc_id", "text").mapInArrow(tidy(cut), _BLOCK_FIELDS)


def _counted(rows: list[tuple], parts: int) -> list[tuple]:
    """Of one part's rows the tokens that came twice or more, with their counts."""
    base = rows[0][1] * _part_size(parts)
    found = [unpacked(body, base) for _, _, _, body, _ in rows]
    every = np.sort(np.concatenate([t for t, _ in found]))
    start = np.flatnonzero(np.append(True, every[1:] != every[:-1]))
    tokens, count = every[start], np.diff(np.append(start, len(every)))
    for (have, owners), (*_, more) in zip(found, rows, strict=True):
        if more:
            at = np.searchsorted(tokens, have[owners == _MANY])
            count[at] += np.frombuffer(more, "<u4").astype(np.int64) - 1
    tokens, count = tokens[count > 1], count[count > 1]
    out = []
    for (have, owners), (block, part, *_) in zip(found, rows, strict=True):
        at = np.searchsorted(tokens, have)
        at[at == len(tokens)] = 0
        hit = tokens[at] == have if len(tokens) else np.zeros(len(have), bool)
        counts = np.minimum(count[at[hit]], 0xFFFFFFFF).astype("<u4")
        out.append((block, part, 0, packed(have[hit], owners[hit], base), zstandard.compress(counts.tobytes(), 1)))
    return out


def _whole(batches: Iterator[pa.RecordBatch], column: int) -> Iterator[list[tuple]]:
    """Rows sorted by a column, in lists of one value each."""
    kept: list[tuple] = []
    for batch in batches:
        for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if kept and kept[0][column] != row[column]:
                yield kept
                kept = []
            kept.append(row)
    if kept:
        yield kept


def prefix_sizes(sizes: np.ndarray, percent: int) -> np.ndarray:
    return sizes - -(-percent * sizes // 100) + 1


def _lists(values: np.ndarray, sizes: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(sizes)), pa.int32()), pa.array(values, pa.int64()))


def _block_sets(rows: list[tuple], parts: int, percent: int, salt_bits: int) -> pa.RecordBatch:
    """The sets of one block's rows, from what its parts have sent back."""
    known = [r for r in rows if r[2] == 1]
    replies = [r for r in rows if r[2] == 0]
    known = pickle.loads(zstandard.decompress(known[0][3])) if len(known) == 1 else None
    if known is None or known["parts"] != len(replies):
        raise RuntimeError("the rows of a block have changed between two runs of a task: give a table whose order of rows is fixed")
    found = [(*unpacked(body, part * _part_size(parts)), np.frombuffer(zstandard.decompress(more), "<u4")) for _, part, _, body, more in replies]
    tokens, owners, counts = (np.concatenate(x) for x in zip(*found, strict=True)) if found else (np.empty(0, np.uint64), np.empty(0, np.uint16), np.empty(0, np.uint32))
    many = owners == _MANY
    if many.any():
        hot, n = known["hot"], counts[many][np.argsort(tokens[many])]
        n = n[np.searchsorted(np.sort(tokens[many]), hot["tokens"])]
        tokens, owners, counts = (np.concatenate(x) for x in ((tokens[~many], hot["tokens"]), (owners[~many], hot["owners"]), (counts[~many], n)))
    ids, first = known["ids"], known["first"]
    n_rows = len(ids)
    row = np.flatnonzero((first == np.arange(n_rows)) & (known["sizes"] > 0))  # an owner's row
    n = known["sizes"][row].astype(np.int64)
    shared = np.bincount(owners, minlength=len(row))
    alone = n - shared
    want = np.clip(prefix_sizes(n, percent) - alone, 0, shared)
    live = want[owners] > 0
    tokens, owners, counts = tokens[live], owners[live].astype(np.int64), counts[live].astype(np.int64)
    level = np.frexp(counts.astype(np.float64))[1].astype(np.int64) - 1  # log2, rounded down
    begin = np.cumsum(np.where(want > 0, shared, 0)) - np.where(want > 0, shared, 0)

    def ordered(rank: np.ndarray, order: int) -> np.ndarray:
        at = np.lexsort((mix(tokens, 101 + order), rank, owners))
        return at[np.arange(len(at)) - begin[owners[at]] < want[owners[at]]]

    at = ordered(counts, 0)
    who = owners[at]
    place = alone[who] + np.arange(len(at)) - (np.cumsum(want) - want)[who]
    early = (n[who] - place) * (100 + percent) >= 2 * percent * n[who]
    spread = np.maximum(level[at] - salt_bits, 0)
    salt = np.where(spread > 0, 1 + (mix(ids[row][who].view(np.uint64), 5).view(np.int64) & ((1 << spread) - 1)), 0)
    in_rows = lambda x: np.bincount(row, weights=x, minlength=n_rows).astype(np.int64)
    sizes, all_sizes = in_rows(want), in_rows(np.where(want > 0, shared, 0))
    digest = np.array([[d >> 64, d & 0xFFFFFFFFFFFFFFFF] for d in known["digests"]], np.uint64).reshape(-1, 2).view(np.int64)
    columns = [pa.array(ids), pa.array(known["sizes"]), pa.array(digest[:, 0]), pa.array(digest[:, 1]), pa.array(ids[first])]
    columns += [_lists(tokens[at].view(np.int64), sizes), _lists((salt << 32) | (early.astype(np.int64) << 31) | place, sizes)]
    columns += [_lists(tokens[ordered(level, k)].view(np.int64), sizes) for k in range(1, ORDERS)]
    columns.append(_lists(tokens[np.argsort(owners, kind="stable")].view(np.int64), all_sizes))
    bit = np.unique(owners * 64 * BITMAP + (mix(tokens, 55) % np.uint64(64 * BITMAP)).astype(np.int64))
    word, first_bit = np.unique(bit >> 6, return_index=True)
    bitmaps = np.zeros((len(row), BITMAP), np.uint64)
    if len(bit):
        bitmaps.ravel()[word] = np.add.reduceat(np.uint64(1) << (bit & 63).astype(np.uint64), first_bit)
    columns.append(_lists(bitmaps[want > 0].ravel().view(np.int64), in_rows(np.where(want > 0, BITMAP, 0))))
    return pa.RecordBatch.from_arrays(columns, names=["doc_id", "n", "d1", "d2", "same", "t0", "places", *(f"t{k}" for k in range(1, ORDERS)), "shared", "bitmap"])


def document_sets(docs: DataFrame, percent: int = 75) -> DataFrame:
    """Of every row of docs (doc_id long, text): doc_id, n (set size), d1 and d2 (the set's digest), same (doc_id of the first row
    with this set in its block), the prefixes t0, t1, ... in each order and places of t0's tokens, all tokens that other sets have
    as well (shared) and the bitmap of these.

    Prefixes lack the tokens that no other set has; where nothing is left of them, and for rows after the first with their
    set, all arrays are empty. A place holds the salt, whether the token comes early enough to be the first that the set
    shares with one at least as large, and the position.
    """
    ship_code(docs.sparkSession)
    # One number reaches the driver: the bytes of all texts.
    parts = max(1, -(-(docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0) // PART_BYTES))
    salt_bits = SALT_BITS

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _whole(batches, 1):
            if known := [r for r in rows if r[2] == 1]:
                yield _sent(known)
            if rows := [r for r in rows if r[2] == 0]:
                yield _sent(_counted(rows, parts))

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _whole(batches, 0):
            yield _block_sets(rows, parts, percent, salt_bits)

    counted = _blocks(docs, parts).repartition(parts, "part").sortWithinPartitions("part").mapInArrow(tidy(count), _BLOCK_FIELDS)
    more = ", ".join(f"t{k} array<long>" for k in range(1, ORDERS))
    fields = f"doc_id long, n int, d1 long, d2 long, same long, t0 array<long>, places array<long>, {more}, shared array<long>, bitmap array<long>"
    return counted.repartition("block").sortWithinPartitions("block").mapInArrow(tidy(gather), fields)


# --- links


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted (token, salt, doc_id) rows with the run's first doc_id; runs of one row are left out unless they are salted. One row is held back."""
    names = ["token", "doc_id", "hub", "place"]
    hub, before, held = 0, None, None
    for batch in batches:
        token, doc, place = (batch.column(i).to_numpy() for i in range(3))
        if not len(token):
            continue
        salt = place >> 32
        new = np.append(before != (token[0], salt[0]), (token[1:] != token[:-1]) | (salt[1:] != salt[:-1]))
        first = np.flatnonzero(new)
        run = np.cumsum(new) - 1
        hubs = np.where(run >= 0, doc[first][np.maximum(run, 0)] if len(first) else hub, hub)
        follows = np.append(~new[1:], False)
        keep = ~new | follows | (salt > 0)
        if held is not None and not new[0]:
            yield pa.RecordBatch.from_arrays([pa.array([x], pa.int64()) for x in held], names=names)
        held = (int(token[-1]), int(doc[-1]), int(hubs[-1]), int(place[-1])) if new[-1] and salt[-1] == 0 else None
        before, hub = (token[-1], salt[-1]), int(hubs[-1])
        if keep.any():
            yield pa.RecordBatch.from_arrays([pa.array(x[keep], pa.int64()) for x in (token, doc, hubs, place)], names=names)


def _limits(percent: int) -> tuple[str, str, str]:
    """SQL on n_a and n_b: sizes can pass; tokens that they must share; tokens they may share after the prefix that ends first."""
    return f"100L * least(n_a, n_b) >= {percent}L * greatest(n_a, n_b)", f"ceil({percent}d * (n_a + n_b) / {100 + percent}d - 1e-9)", f"ceil({percent}L * greatest(n_a, n_b) / 100d) - 1"


def _verified(pairs: DataFrame, sets: DataFrame, percent: int, put: Scratch) -> DataFrame:
    """Those of pairs (a, b) that share enough prefix tokens in every order, and enough tokens in all.

    Pairs are written first: their size decides how they meet the sets, of which only those in pairs are moved.
    """

    def side(s: str, of: DataFrame, *columns: str) -> DataFrame:
        named = sets.select(F.col("doc_id").alias(s), *(F.col(c).alias(f"{c}_{s}") for c in ("n", *columns)))
        return named.join(of.select(s).distinct(), s, "left_semi")

    fits, need, beyond = _limits(percent)
    orders = [f"t{k}" for k in range(ORDERS)]
    agree = " and ".join(f"size(array_intersect({t}_a, {t}_b)) + {beyond} >= {need}" for t in orders)
    pairs = put(pairs, "pairs")
    near = put(pairs.join(side("a", pairs, *orders), "a").join(side("b", pairs, *orders), "b").where(f"{fits} and {agree}").select("a", "b").distinct(), "near")
    both = near.join(side("a", near, "shared"), "a").join(side("b", near, "shared"), "b").select("a", "b", "n_a", "n_b", F.size(F.array_intersect("shared_a", "shared_b")).alias("c"))
    return both.where(f"100L * c >= {percent}L * (n_a + n_b - c)").select("a", "b").distinct()


def _mixed_runs(runs: DataFrame, parts: DataFrame, sizes: DataFrame) -> DataFrame:
    """The rows of the runs with more than one component c and an early row, each with its run's size and largest component (main)."""
    place = F.expr("int(place & 2147483647L) as pos"), F.expr("(place >> 31) & 1L = 1 as early")
    known = runs.join(parts.withColumnRenamed("id", "doc_id"), "doc_id", "left").select("token", "doc_id", *place, F.coalesce("component", "doc_id").alias("c"))
    counts = known.groupBy("token", "c").agg(F.count("*").alias("m"), F.bool_or("early").alias("early"))
    counts = counts.groupBy("token").agg(F.sum("m").alias("size"), F.max(F.struct("m", "c")).alias("most"), F.bool_or("early").alias("any"))
    mixed = counts.where("any and most.m < size").select("token", "size", F.col("most.c").alias("main"))
    return known.join(mixed, "token").join(sizes, "doc_id")


def _hub_pairs(mixed: DataFrame, fits: str, turn: int, hubs: int) -> DataFrame:
    """Pairs (a, b) of each document outside its runs' largest components with members of these, `hubs` at most.

    The members are drawn by hash, so each turn tries others; those that share most runs come first.
    """
    rows = mixed.withColumn("inside", F.expr("if(c = main, struct(doc_id, n), null)"))
    draw = [F.min_by("inside", F.when(F.col("inside").isNotNull(), F.xxhash64("doc_id", F.lit(turn * hubs + i)))) for i in range(hubs)]
    drawn = rows.groupBy("token").agg(F.array_distinct(F.array(*draw)).alias("hubs"))
    pairs = mixed.where("c <> main").select("token", "doc_id", F.col("n").alias("n_b")).join(drawn, "token").select(F.col("doc_id").alias("b"), "n_b", F.explode("hubs").alias("hub"))
    pairs = pairs.select(F.col("hub.doc_id").alias("a"), F.col("hub.n").alias("n_a"), "b", "n_b").where(fits).groupBy("a", "b").agg(F.count("*").alias("c"))
    best = Window.partitionBy("b").orderBy(F.desc("c"), "a")
    return pairs.withColumn("r", F.row_number().over(best)).where(F.col("r") <= hubs).select("a", "b")


def _cross_pairs(mixed: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) of documents of a run in different components for which its token may be the first that they share."""
    fits, need, _ = _limits(percent)
    words = [f"w{i}" for i in range(BITMAP)]
    side = lambda s: [F.col(k).alias(f"{k}_{s}") for k in ("doc_id", "pos", "c", "n", "m", *words)]
    apart = " + ".join(f"bit_count({w}_a ^ {w}_b)" for w in words)  # at most the tokens that just one of both has
    # The first token that two similar sets share leaves enough of both; it is early in the smaller one.
    first = f"least(n_a - pos_a, n_b - pos_b) >= {need} and c_a <> c_b and {fits} and (n_a < n_b or n_a = n_b and doc_id_a < doc_id_b) and m_a + m_b - ({apart}) >= 2 * {need}"
    early = mixed.where("early").select("token", "main", *side("a"))
    outside = early.where("c_a <> main").join(mixed.select("token", *side("b")), "token").where(first)
    inside = early.where("c_a = main").join(mixed.where("c <> main").select("token", *side("b")), "token").where(first)
    return outside.unionByName(inside).select(F.least("doc_id_a", "doc_id_b").alias("a"), F.greatest("doc_id_a", "doc_id_b").alias("b")).distinct()


def _linked(whole: DataFrame, percent: int, hubs: int, put: Scratch) -> tuple[DataFrame, DataFrame]:
    """doc_id and n of every document; id, component of every document that isn't its component's smallest. The table of sets is dropped."""
    every = put(whole.select("doc_id", "n", "same"), "rows")
    copies = every.where("same <> doc_id").select(F.col("same").alias("a"), F.col("doc_id").alias("b"))
    of_set = Window.partitionBy("d1", "d2").orderBy("doc_id")
    # A block has sent each set once, so of however many copies one row a block meets here.
    firsts = whole.where("n > 0 and same = doc_id").withColumn("rep", F.first("doc_id").over(of_set)).withColumn("nth", F.row_number().over(of_set))
    firsts = put(firsts.drop("d1", "d2", "same"), "firsts")
    put.drop(whole)
    copies = copies.unionByName(firsts.where("rep <> doc_id").select(F.col("rep").alias("a"), F.col("doc_id").alias("b")))
    sets = firsts.where("nth = 1 and size(t0) > 0").drop("rep", "nth")
    words = [F.col("bitmap")[i].alias(f"w{i}") for i in range(BITMAP)]
    sizes = sets.select("doc_id", "n", F.size("shared").alias("m"), *words).distinct()

    rows = sets.select("doc_id", F.explode(F.arrays_zip("t0", "places")).alias("x")).select(F.col("x.t0").alias("token"), "doc_id", F.col("x.places").alias("place"))
    salt = F.shiftright("place", 32)
    runs = put(rows.repartition("token", salt).sortWithinPartitions("token", salt, "doc_id").mapInArrow(_runs, "token long, doc_id long, hub long, place long"), "runs")
    fits, need, beyond = _limits(percent)
    enough = f"c + {beyond} >= {need}"
    side = lambda c: sizes.select(F.col("doc_id").alias(c), F.col("n").alias(f"n_{c}"))
    pairs = runs.select(F.col("hub").alias("a"), F.col("doc_id").alias("b")).where("a <> b").groupBy("a", "b").agg(F.count("*").alias("c"))
    pairs = pairs.join(side("a"), "a").join(side("b"), "b").where(f"{fits} and {enough}").select("a", "b")
    heads = runs.where(salt > 0).select("token", "hub").distinct()
    across = heads.join(heads.groupBy("token").agg(F.min("hub").alias("a")), "token").select("a", F.col("hub").alias("b")).where("a <> b")
    links = copies.unionByName(_verified(pairs.unionByName(across).distinct(), sets, percent, put))
    parts = connected_components(links, put)

    edges = lambda parts, more: parts.select(F.col("component").alias("a"), F.col("id").alias("b")).unionByName(more)
    mixed, before, turn = put(_mixed_runs(runs, parts, sizes), "mixed"), None, 0
    while True:
        size = mixed.agg(F.count("*").alias("rows"), F.sum(F.expr("if(early and c <> main, size, 0)")).alias("work")).first()
        if size["rows"] == 0 or size["work"] <= WORK_A_ROW * size["rows"] or (before is not None and size["work"] > 0.9 * before):
            break
        more = put(_verified(_hub_pairs(mixed, fits, turn, hubs), sets, percent, put), "links")
        if more.isEmpty():
            break
        parts = connected_components(edges(parts, more), put)
        mixed, before, turn = put(_mixed_runs(runs, parts, sizes), "mixed"), size["work"], turn + 1
    more = put(_verified(_cross_pairs(mixed, percent), sets, percent, put), "links")
    return every, parts if more.isEmpty() else connected_components(edges(parts, more), put)


def jaccard_components(docs: DataFrame, percent: int = 75) -> DataFrame:
    """doc_id, n_shingles, component_id of every row of docs (doc_id long, text); 0 and null for a null doc_id, as in SQL."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    unnamed = docs.where("doc_id is null").selectExpr("doc_id", "0L as n_shingles", "doc_id as component_id")
    with Scratch(docs.sparkSession, "jaccard") as put:
        every, parts = _linked(put(document_sets(docs.where("doc_id is not null"), percent), "sets"), percent, HUBS, put)
        found = every.select("doc_id", F.col("n").cast("long").alias("n_shingles")).join(parts.withColumnRenamed("id", "doc_id"), "doc_id", "left")
        found = stage(found.select("doc_id", "n_shingles", F.coalesce("component", "doc_id").alias("component_id")), "components")
    return found.unionByName(unnamed)
