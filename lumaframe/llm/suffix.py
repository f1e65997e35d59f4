"""Removal of repeated byte strings by suffix arrays built with induced sorting.

Every byte covered by a string of `length` bytes that also starts elsewhere, in the same document or another, is removed.

1. Anchors: a window of `length` bytes is named after the smallest hash among its GRAM-byte grams, the leftmost if several.
   Equal windows have equal anchors at equal places, so they meet in the shard of their anchor. Consecutive windows with
   one anchor form a segment, which stands for all of them.
2. Shards: segments are dealt out by anchor and sorted. Equal segments that come twice repeat in all their windows. An anchor
   with one segment repeats nowhere. Only different segments with one anchor, found around the ends of passages, are compared.
3. Their bytes are joined into shard texts, closed by separators. Each shard's suffix array is built by induced sorting
   (suffix types, recursively sorted leftmost-smaller substrings, two linear inducing passes), its permuted common prefixes
   follow from the irreducible ones, and a window repeats if it shares `length` bytes with a neighbour in suffix order.

In 2, segments count as equal if the 64-bit hashes of their bytes and of their anchors and its place are equal; their bytes are
not compared. That is the one place where a hash decides.

A null text is empty and has nothing to remove. Repeated rows repeat each other. Texts under `length` bytes stay whole, texts of
any length are read whole, in blocks. An empty table gives an empty result. Other columns are not read, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumaframe.llm.words import mix, texts_of, tidy
from lumaframe.session import ship_code, stage

GRAM = 64
#: Bytes that are hashed at once, and bytes of segments in one suffix array.
BLOCK_BYTES, SHARD_BYTES = 1 << 15, 2 << 20
#: An anchor with more different segments is dealt out by window offsets too: equal windows have equal offsets to their anchor.
HOT_SEGMENTS, OFFSETS = 4_000, 16
_LOW = (1 << 24) - 1


# --- suffix arrays


def suffix_types(s: np.ndarray) -> np.ndarray:
    """True for smaller-type suffixes; s ends with a unique smallest value."""
    n = len(s)
    change = np.append(np.flatnonzero(s[:-1] != s[1:]), n - 1)
    smaller = np.append(s[:-1] < s[1:], True)
    return np.repeat(smaller[change], np.diff(np.append(-1, change)))


def _placed(values: np.ndarray, keys: np.ndarray, sizes: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """values and keys in stable key order, and each one's place among those of its key."""
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    first = np.searchsorted(keys, np.arange(sizes))
    return values[order], keys, np.arange(len(keys)) - first[keys]


def _induce(s: np.ndarray, small: np.ndarray, starts: np.ndarray, ends: np.ndarray, seeds: np.ndarray, size: int) -> np.ndarray:
    """Both inducing passes, bucket by bucket; what one bucket induces is placed at once. seeds: sorted leftmost-smaller suffixes."""
    n = len(s)
    sa = np.full(n, -1, np.int32)
    seed_keys = s[seeds]
    seed_at = np.searchsorted(seed_keys, np.arange(size + 1))
    heads = starts.copy()
    present = np.flatnonzero(ends > starts)

    def push(found: np.ndarray) -> None:
        values, keys, nth = _placed(found, s[found], size)
        sa[heads[keys] + nth] = values
        np.add.at(heads, keys, 1) if len(keys) < 64 else heads.__iadd__(np.bincount(keys, minlength=size))

    for c in present:
        front = sa[starts[c] : heads[c]]
        while len(front):
            before = front[front > 0] - 1
            before = before[~small[before]]
            if not len(before):
                break
            at = heads[c]
            push(before)
            front = sa[at : heads[c]]
        front = seeds[seed_at[c] : seed_at[c + 1]]
        if len(front) and (front := front[front > 0] - 1).size:
            push(front[~small[front]])
    larger_ends = heads.copy()
    tails = ends - 1
    sa[0] = n - 1
    tails[0] -= 1

    def pull(found: np.ndarray) -> None:
        values, keys, nth = _placed(found, s[found], size)
        sa[tails[keys] - nth] = values
        np.subtract.at(tails, keys, 1) if len(keys) < 64 else tails.__isub__(np.bincount(keys, minlength=size))

    for c in present[::-1]:
        front = sa[tails[c] + 1 : ends[c]][::-1]
        while len(front):
            before = front[front > 0] - 1
            before = before[small[before]]
            if not len(before):
                break
            at = tails[c]
            pull(before)
            front = sa[tails[c] + 1 : at + 1][::-1]
        front = sa[starts[c] : larger_ends[c]][::-1]
        front = front[front > 0] - 1
        if (front := front[small[front]]).size:
            pull(front)
    return sa


def _names(s: np.ndarray, leftmost: np.ndarray, ordered: np.ndarray) -> tuple[np.ndarray, int]:
    """The rank of each leftmost-smaller substring (equal ones have one), in text order, and the number of ranks. ordered: leftmost in substring order."""
    n = len(s)
    length = np.zeros(n, np.int32)
    length[leftmost] = np.diff(np.append(leftmost, n - 1)) + 1
    a, b = ordered[:-1], ordered[1:]
    same = length[a] == length[b]
    live, k = np.flatnonzero(same), 0
    while len(live):
        equal = s[a[live] + k] == s[b[live] + k]
        same[live[~equal]] = False
        k += 1
        live = live[equal]
        live = live[length[a[live]] > k]
    rank = np.concatenate([[0], np.cumsum(~same)]).astype(np.int32)
    at = np.empty(n, np.int32)
    at[ordered] = rank
    return at[leftmost], int(rank[-1]) + 1


def _sort_names(names: np.ndarray, size: int) -> np.ndarray:
    """Suffix array of the reduced string by the same induced sorting, one value at a time: its alphabet is too large for whole buckets."""
    n = len(names)
    if size == n:
        order = np.empty(n, np.int32)
        order[names] = np.arange(n, dtype=np.int32)
        return order
    smaller = suffix_types(names)
    counts = np.bincount(names, minlength=size)
    first_end = np.cumsum(counts)
    leftmost = np.flatnonzero(smaller[1:] & ~smaller[:-1]) + 1
    values, small, starts, ends = names.tolist(), smaller.tolist(), (first_end - counts).tolist(), first_end.tolist()

    def induce(seeds: list[int]) -> np.ndarray:
        sa = [-1] * n
        tails = ends[:]
        for i in reversed(seeds):
            v = values[i]
            at = tails[v] = tails[v] - 1
            sa[at] = i
        heads = starts[:]
        for i in sa:  # what is written ahead of here is read later
            if i > 0 and not small[i - 1]:
                i -= 1
                v = values[i]
                at = heads[v]
                sa[at] = i
                heads[v] = at + 1
        tails = ends[:]
        sa[0] = n - 1
        for x in range(n - 1, -1, -1):
            i = sa[x] - 1
            if i >= 0 and small[i]:
                v = values[i]
                at = tails[v] = tails[v] - 1
                sa[at] = i
        return np.array(sa, np.int32)

    mark = np.zeros(n, bool)
    mark[leftmost] = True
    first = induce(leftmost.tolist())
    reduced, count = _names(names, leftmost, first[mark[first]])
    return induce(leftmost[_sort_names(reduced, count)].tolist())


def suffix_array(s: np.ndarray) -> np.ndarray:
    """Suffix array of small non-negative integers; the last value is the only 0."""
    n, size = len(s), int(s.max()) + 1
    if n == 1:
        return np.zeros(1, np.int64)
    small = suffix_types(s)
    counts = np.bincount(s, minlength=size)
    ends = np.cumsum(counts)
    starts = ends - counts
    leftmost = np.flatnonzero(small[1:] & ~small[:-1]) + 1
    by_value = leftmost[np.argsort(s[leftmost], kind="stable")]
    first = _induce(s, small, starts, ends, by_value, size)
    mark = np.zeros(n, bool)
    mark[leftmost] = True
    names, count = _names(s, leftmost, first[mark[first]])
    return _induce(s, small, starts, ends, leftmost[_sort_names(names, count)], size)


def permuted_prefixes(s: np.ndarray, sa: np.ndarray, least: int = 2) -> tuple[np.ndarray, np.ndarray]:
    """Each suffix's predecessor in suffix order, and how long a prefix they share; values under `least` match nothing.

    Only irreducible entries (what stands before the two suffixes differs) are compared, all at once value by value; each
    other entry is one less than the one before it.
    """
    n = len(s)
    phi = np.empty(n, np.int32)
    phi[sa[1:]] = sa[:-1]
    phi[sa[0]] = sa[0]
    i = np.arange(n, dtype=np.int32)
    reducible = (i > 0) & (phi > 0)
    reducible[1:] &= (s[:-1] == s[phi[1:] - 1]) & (s[:-1] >= least) & (phi[1:] > 0)
    heads = np.flatnonzero(~reducible)
    shared = np.zeros(n, np.int32)
    a, b, live = heads, phi[heads], np.arange(len(heads))
    found = np.zeros(len(heads), np.int32)
    while len(live):
        x, y = a[live] + found[live], b[live] + found[live]
        ok = (x < n) & (y < n) & (x != y)
        live, x, y = live[ok], x[ok], y[ok]
        equal = (s[x] == s[y]) & (s[x] >= least)
        live = live[equal]
        found[live] += 1
    last = np.maximum.accumulate(np.where(reducible, np.int32(-1), i))
    shared[heads] = found
    return phi, np.maximum(shared[last] - (i - last), 0)


def repeated_windows(texts: list[bytes], length: int) -> list[np.ndarray]:
    """For each text, which starts of `length` bytes also start elsewhere in these texts."""
    sizes = np.array([len(t) for t in texts])
    s = np.ones(int(sizes.sum()) + len(texts) + 1, np.uint16)
    s[-1] = 0
    ends = np.cumsum(sizes + 1) - 1
    raw = np.frombuffer(b"\0".join(texts), np.uint8)
    s[: len(raw)] = raw.astype(np.uint16) + 2
    s[ends] = 1
    sa = suffix_array(s)
    phi, shared = permuted_prefixes(s, sa)
    long = shared >= length
    again = long.copy()
    again[phi[long]] = True
    return [again[e - n : e - length + 1] if n >= length else np.zeros(0, bool) for e, n in zip(ends.tolist(), sizes.tolist(), strict=True)]


# --- anchors


def segments(texts: list[bytes], length: int, gram: int = GRAM) -> tuple[np.ndarray, ...]:
    """Of all texts together: text number, start, number of windows, anchor hash, anchor's offset from the start, content hash."""
    sizes = np.array([len(t) for t in texts], np.int64)
    flat = np.frombuffer(b"".join(texts), np.uint8)
    if len(flat) < length:
        return tuple(np.empty(0, np.int64) for _ in range(6))
    h, done, rest, at = flat.astype(np.uint64), 1, gram, None
    h = h + np.uint64(1)
    odd = 0x9E3779B97F4A7C15
    total, covered = None, 0
    while rest:
        if rest & 1:
            if total is None:
                total, covered = h.copy(), done
            else:
                n = len(flat) - covered - done + 1
                total = total[:n] * np.uint64(pow(odd, 2 * done + 1, 1 << 64) | 1) + h[covered : covered + n]
                covered += done
        rest >>= 1
        if rest:
            h = h[:-done] * np.uint64(pow(odd, 2 * done + 1, 1 << 64) | 1) + h[done:]
            done *= 2
    hashes = mix(total, 11)
    key = (hashes & np.uint64(0xFFFFFFFFFF000000)) | np.arange(len(hashes), dtype=np.uint64)
    width, have = length - gram + 1, 1
    while have * 2 <= width:
        key = np.minimum(key[:-have], key[have:])
        have *= 2
    if have < width:
        key = np.minimum(key[: len(key) - (width - have)], key[width - have :])
    anchor = (key & np.uint64(_LOW)).astype(np.int64)
    ends = np.cumsum(sizes)
    owner = np.repeat(np.arange(len(texts)), sizes)[: len(anchor)]
    fits = np.arange(len(anchor)) + length <= ends[owner]
    new = np.ones(len(anchor), bool)
    new[1:] = (anchor[1:] != anchor[:-1]) | (owner[1:] != owner[:-1])
    new &= fits
    first = np.flatnonzero(new)
    stops = np.ones(len(anchor) + 1, bool)
    stops[:-1] = new | ~fits
    stop_at = np.flatnonzero(stops)
    windows = stop_at[np.searchsorted(stop_at, first, "right")] - first
    joined, digest = flat.tobytes(), xxhash.xxh3_64_intdigest
    content = np.fromiter((digest(joined[a : a + n]) for a, n in zip(first.tolist(), (windows + length - 1).tolist(), strict=True)), np.uint64, len(first))
    mark, begin = anchor[first], (ends - sizes)[owner[first]]
    return owner[first], first - begin, windows, hashes[mark].view(np.int64), mark - first, mix(content + (mark - first).astype(np.uint64), 13).view(np.int64)


def merged(intervals: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for a, b in sorted(intervals):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


def _text_blocks(column: pa.Array, limit: int) -> Iterator[tuple[int, list[bytes]]]:
    a, block, size = 0, [], 0
    for i, text in enumerate(texts_of(column)):
        raw = (text or "").encode("utf-8", "surrogatepass")
        if block and size + len(raw) > limit:
            yield a, block
            a, block, size = i, [], 0
        block.append(raw)
        size += len(raw)
    if block:
        yield a, block


def _long_segments(raw: bytes, length: int) -> tuple[np.ndarray, ...]:
    """segments() of one text of any size: runs overlap by `length` - 1 bytes, so that each window is in just one."""
    parts, step = [], 4 * BLOCK_BYTES
    for a in range(0, max(1, len(raw) - length + 1), step):
        found = segments([raw[a : a + step + length - 1]], length)
        parts.append((found[0], found[1] + a, *found[2:]))
    return tuple(np.concatenate(x) for x in zip(*parts, strict=True))


def _rows(docs: DataFrame, length: int) -> DataFrame:
    return docs.where(F.octet_length("text") >= length).select("doc_id", F.xxhash64("text").alias("th"), "text")


def _hits(rows: DataFrame, length: int) -> DataFrame:
    """The staged table of segments that come again or may share a part, with their kind: see _compare()."""
    key = rows.schema["doc_id"].dataType.simpleString()

    def anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, block in _text_blocks(batch.column(2), BLOCK_BYTES):
                found = _long_segments(block[0], length) if len(block) == 1 else segments(block, length)
                row = pa.array(found[0] + a)
                yield pa.RecordBatch.from_arrays([batch.column(0).take(row), batch.column(1).take(row), *(pa.array(x, t) for x, t in zip(found[1:], (pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.int64()), strict=True))], names=["doc_id", "th", "start", "windows", "anchor", "mark", "content"])

    schema = f"doc_id {key}, th long, start long, windows int, anchor long, mark int, content long"
    dealt = rows.mapInArrow(tidy(anchors), schema).repartition("anchor").sortWithinPartitions("anchor", "content")
    return stage(dealt.mapInArrow(tidy(_compare), f"{schema}, kind int"), "anchors")


def _shards(rows: DataFrame, hits: DataFrame, length: int) -> DataFrame:
    """doc_id, th, start, anchor, sub, kind, piece of the segments to compare, those of one anchor (and offset class) together."""
    key = rows.schema["doc_id"].dataType.simpleString()
    asked = hits.where("kind > 0")
    hot = asked.groupBy("anchor").agg(F.count("*").alias("n")).where(F.col("n") > HOT_SEGMENTS)
    asked = asked.join(hot, "anchor", "left").groupBy("doc_id", "th").agg(F.collect_list(F.struct("start", "windows", "anchor", "mark", "kind", F.col("n").isNotNull().alias("hot"))).alias("asked"))
    found = asked.withColumnRenamed("doc_id", "id").join(rows, F.col("id").eqNullSafe(F.col("doc_id")) & (asked["th"] == rows["th"])).select("doc_id", rows["th"], "text", "asked")
    each = -(-(length - GRAM + 1) // OFFSETS)

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            row, out = [], ([], [], [], [], [])
            for i, (text, wanted) in enumerate(zip(texts_of(batch.column(2)), texts_of(batch.column(3)), strict=True)):
                raw = text.encode("utf-8", "surrogatepass")
                for w in wanted:
                    runs = [(0, w["windows"], -1)]
                    if w["hot"]:
                        classes = (w["mark"] - np.arange(w["windows"])) // each
                        cuts = [0, *(np.flatnonzero(np.diff(classes)) + 1).tolist(), w["windows"]]
                        runs = [(x, y, int(classes[x])) for x, y in zip(cuts, cuts[1:], strict=False)]
                    for x, y, sub in runs:
                        start = w["start"] + x
                        row.append(i)
                        for column, value in zip(out, (start, w["anchor"], sub, w["kind"], raw[start : start + y - x + length - 1]), strict=True):
                            column.append(value)
            at = pa.array(row, pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0).take(at), batch.column(1).take(at), *(pa.array(x, t) for x, t in zip(out, (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.binary()), strict=True))], names=["doc_id", "th", "start", "anchor", "sub", "kind", "piece"])

    return found.mapInArrow(tidy(extract), f"doc_id {key}, th long, start long, anchor long, sub int, kind int, piece binary").repartition("anchor", "sub").sortWithinPartitions("anchor", "sub")


def repeats(docs: DataFrame, length: int = 200) -> DataFrame:
    """doc_id, th (hash of the text), spans: sorted disjoint byte intervals to remove, of the rows that have any."""
    ship_code(docs.sparkSession)
    key = docs.schema["doc_id"].dataType.simpleString()
    rows = _rows(docs, length)
    hits = _hits(rows, length)
    shards = _shards(rows, hits, length)

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: list[pa.RecordBatch] = []
        size = 0

        def solve(table: pa.Table) -> Iterator[pa.RecordBatch]:
            table = table.combine_chunks()
            pieces = table["piece"].to_pylist()
            row, begin, end = [], [], []
            starts, kinds = table["start"].to_pylist(), table["kind"].to_pylist()
            for i, again in enumerate(repeated_windows(pieces, length) if pieces else []):
                if kinds[i] == 1 and again.any():
                    edge = np.flatnonzero(np.diff(np.concatenate([[0], again.astype(np.int8), [0]])))
                    for x, y in merged([(a, b - 1 + length) for a, b in zip(edge[::2].tolist(), edge[1::2].tolist(), strict=True)]):
                        row.append(i)
                        begin.append(starts[i] + x)
                        end.append(starts[i] + y)
            if row:
                at = pa.array(row, pa.int64())
                yield pa.RecordBatch.from_arrays([table["doc_id"].combine_chunks().take(at), table["th"].combine_chunks().take(at), pa.array(begin, pa.int64()), pa.array(end, pa.int64())], names=["doc_id", "th", "a", "b"])

        for batch in batches:
            kept.append(batch)
            size += batch.column(6).nbytes
            if size >= SHARD_BYTES:
                table = pa.Table.from_batches(kept).combine_chunks()
                anchor, sub = table["anchor"].to_numpy(), table["sub"].to_numpy()
                cut = np.flatnonzero((anchor[1:] != anchor[:-1]) | (sub[1:] != sub[:-1])) + 1
                if len(cut):
                    yield from solve(table.slice(0, int(cut[-1])))
                    table = table.slice(int(cut[-1]))
                    kept, size = table.combine_chunks().to_batches(), table["piece"].nbytes
        if kept:
            yield from solve(pa.Table.from_batches(kept))

    spans = shards.mapInArrow(tidy(search), f"doc_id {key}, th long, a long, b long")
    whole = hits.where("kind = 0").select("doc_id", "th", F.col("start").alias("a"), (F.col("start") + F.col("windows") - 1 + length).alias("b"))
    return whole.unionByName(spans).groupBy("doc_id", "th").agg(F.collect_list(F.struct("a", "b")).alias("spans"))


#: Rows of one anchor that are held until it ends; then those of which all is known are passed on.
HELD_ROWS = 50_000


def _compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by anchor and content, with kind 0: the segment comes again as a whole; 1: to be compared with others of its anchor; 2: one of kind 0, to compare those with.

    Segments whose anchor has no other row are left out. Rows are held until their anchor ends, HELD_ROWS at most.
    """
    held: pa.Table | None = None
    several = False  # the held anchor has had other contents before

    def emit(table: pa.Table, several: bool, upto: int) -> Iterator[pa.RecordBatch]:
        anchor, content = table["anchor"].to_numpy(), table["content"].to_numpy()
        new_anchor = np.append(True, anchor[1:] != anchor[:-1])
        new_content = new_anchor | np.append(True, content[1:] != content[:-1])
        runs = np.flatnonzero(new_content)
        run = np.cumsum(new_content) - 1
        many = np.diff(np.append(runs, len(anchor)))[run] > 1
        group = np.cumsum(new_anchor) - 1
        contents = np.bincount(group, weights=new_content) > 1
        contents[0] |= several
        kind = np.where(many, 0, np.where(contents[group], 1, -1))
        keep = np.flatnonzero(kind[:upto] >= 0)
        rep = np.flatnonzero((new_content & many & contents[group])[:upto])
        if len(keep) + len(rep):
            take, kinds = np.concatenate([keep, rep]), np.concatenate([kind[keep], np.full(len(rep), 2)])
            yield from table.take(pa.array(take)).append_column("kind", pa.array(kinds, pa.int32())).combine_chunks().to_batches()

    for batch in batches:
        if not batch.num_rows:
            continue
        table = pa.Table.from_batches([batch])
        if held is not None:
            table = pa.concat_tables([held, table]).combine_chunks()
        anchor, content = table["anchor"].to_numpy(), table["content"].to_numpy()
        n = len(anchor)
        last = int(np.searchsorted(anchor, anchor[-1]))
        if last:
            yield from emit(table.slice(0, last).combine_chunks(), several, last)
            several = False
        if n - last > HELD_ROWS:
            tail = table.slice(last).combine_chunks()
            run = n - last - int((content[last:] == content[-1])[::-1].argmin() or n - last)
            several = several or run > 0
            cut = max(run, n - last - 2)  # of the last content two rows stay: enough to know that it comes again
            yield from emit(tail, several, cut)
            held = tail.slice(cut)
        else:
            held = table.slice(last)
    if held is not None:
        yield from emit(held.combine_chunks(), several, held.num_rows)


def dedup_substrings(docs: DataFrame, length: int = 200, keep_text: bool = False) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 (and kept, the bytes that remain) of every row of docs (doc_id, text)."""
    key = docs.schema["doc_id"].dataType.simpleString()
    spans = repeats(docs, length).withColumnRenamed("doc_id", "id").withColumnRenamed("th", "id_th")
    every = docs.select("doc_id", "text").withColumn("th", F.xxhash64("text"))
    joined = every.join(spans, F.col("doc_id").eqNullSafe(F.col("id")) & (F.col("th") == F.col("id_th")), "left").select("doc_id", "text", "spans")

    def remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = ([], [], [], [], [])
            for text, found in zip(texts_of(batch.column(1)), texts_of(batch.column(2)), strict=True):
                raw = (text or "").encode("utf-8", "surrogatepass")
                gone = merged([(x["a"], x["b"]) for x in found or []])
                kept = b"".join(raw[a:b] for a, b in zip([0, *(b for _, b in gone)], [*(a for a, _ in gone), len(raw)], strict=True))
                for column, value in zip(out, (len(raw), len(raw) - len(kept), len(gone), hashlib.sha256(kept).hexdigest(), kept if keep_text else None), strict=True):
                    column.append(value)
            types = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary())
            columns = [pa.array(x, t) for x, t in zip(out, types, strict=True)]
            names = ["n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"]
            upto = 5 if keep_text else 4
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns[:upto]], names=["doc_id", *names[:upto]])

    return joined.mapInArrow(tidy(remove), f"doc_id {key}, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", kept binary" * keep_text)
