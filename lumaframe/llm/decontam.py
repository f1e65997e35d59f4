"""Benchmark decontamination by size-partitioned MinHash containment search, verified by exact shingle containment.

Test items are partitioned by the size of their shingle sets (powers of two), and each partition is divided into groups of
GROUP items. Only a document's shingles that some item of a group has can count there, so that part of its set is its domain in
the group: nothing is lost, and long documents become short domains. For a domain of at most u shingles and an item of q, the
containment threshold t is a Jaccard threshold of t / (u / q + 1 - t); the rows to a band of their MinHash signatures are the
most for which a pair at the threshold is missed with a chance below MISS. As a group's items are few and of like sizes, u / q
has a bound and there always is such a layout. Items that share a band with the domain are candidates; only these are verified
by counting the shingles that item and document share. So an item is missed with a chance of MISS at most, once in a billion.

Items and documents are lower-cased (A-Z) words; shingles have five words. An item of 1 to 4 words is one shingle of its own
length, looked up in every document's runs of that many words. Null, empty and wordless items and documents match nothing.
Texts of any length are read whole. Of repeated rows (one doc_id or item_id) the pair with the largest containment is given.
Empty tables give none. Other columns are not read, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumaframe.llm.words import SHINGLE, grams, mix, texts_of, tidy, word_hashes
from lumaframe.session import ship_code

#: Items, and bytes of their texts, in a block; a block is what is sent to the executors at once.
BLOCK_ITEMS, BLOCK_BYTES = 5_000, 8_000_000
PERMUTATIONS, MISS = 256, 1e-9
#: Items of a group, and the rows to a band to choose from.
GROUP, ROWS = 4, (1, 2, 3, 4, 6, 8)
_SEEDS = mix(np.arange(PERMUTATIONS, dtype=np.uint64), 1000)[:, None]


def _signature(tokens: np.ndarray) -> np.ndarray:
    found = np.full(PERMUTATIONS, np.iinfo(np.uint64).max, np.uint64)
    for a in range(0, len(tokens), 2048):
        found = np.minimum(found, mix(tokens[None, a : a + 2048] ^ _SEEDS).min(axis=1))
    return found


def _bands(signatures: np.ndarray, rows: int) -> np.ndarray:
    """Of each signature (the last axis) the values of its bands."""
    n = PERMUTATIONS // rows
    total = np.zeros((*signatures.shape[:-1], n), np.uint64)
    for i in range(rows):
        total = mix(total * np.uint64(31) + signatures[..., i : n * rows : rows], 9)
    return total


def band_rows(size: int, upper: int, percent: int) -> int:
    """The most rows to a band for items of a size and domains of up to upper shingles."""
    t = percent / 100
    least = t / (max(upper, t * size) / size + 1 - t)
    fine = [r for r in ROWS if (1 - least**r) ** (PERMUTATIONS // r) <= MISS]
    return max(fine) if fine else 1


class ItemIndex:
    """One block of items: their shingles, the groups, and the bands of their MinHash signatures."""

    def __init__(self, ids: list, texts: list[str], percent: int) -> None:
        self.ids, self.percent = ids, percent
        hashes = [word_hashes(t) for t in texts]
        self.orders = sorted({min(SHINGLE, len(h)) for h in hashes if len(h)})
        sets = [np.unique(grams(h, min(SHINGLE, len(h)))) if len(h) else np.empty(0, np.uint64) for h in hashes]
        self.sizes = np.array([len(s) for s in sets], np.int64)
        self.tokens = np.unique(np.concatenate(sets)) if sets else np.empty(0, np.uint64)
        self.parts = [np.searchsorted(self.tokens, s) for s in sets]
        by_class: dict[int, list[int]] = {}
        for i in np.argsort(self.sizes, kind="stable").tolist():
            if self.sizes[i]:
                by_class.setdefault((int(self.sizes[i]) - 1).bit_length(), []).append(i)
        self.groups = [items[a : a + GROUP] for items in by_class.values() for a in range(0, len(items), GROUP)]
        words = [np.unique(np.concatenate([self.parts[i] for i in group])) for group in self.groups]
        self.words = [len(w) for w in words]  # no domain in the group is larger
        every = np.concatenate(words) if words else np.empty(0, np.int64)
        order = np.argsort(every, kind="stable")
        self.owners = np.repeat(np.arange(len(words)), self.words)[order]
        self.starts = np.searchsorted(every[order], np.arange(len(self.tokens) + 1))
        self.signatures: dict[int, np.ndarray] = {}
        self.tables: dict[tuple[int, int], np.ndarray] = {}

    def table(self, item: int, rows: int) -> np.ndarray:
        if (item, rows) not in self.tables:
            if item not in self.signatures:
                self.signatures[item] = _signature(self.tokens[self.parts[item]])
            self.tables[item, rows] = _bands(self.signatures[item], rows)
        return self.tables[item, rows]

    def search(self, text: str | None) -> list[tuple[int, int]]:
        """(item number, shared shingles) of the items that the text contains."""
        hashes = word_hashes(text)
        if not len(hashes) or not len(self.tokens):
            return []
        found = np.concatenate([grams(hashes, k) for k in self.orders])
        at = np.searchsorted(self.tokens, found)
        at[at == len(self.tokens)] = 0
        at = np.unique(at[self.tokens[at] == found])
        if not len(at):
            return []
        count = self.starts[at + 1] - self.starts[at]
        group = np.concatenate([self.owners[self.starts[i] : self.starts[i + 1]] for i in at])
        order = np.argsort(group, kind="stable")
        group, token = group[order], np.repeat(at, count)[order]
        edges = np.append(np.flatnonzero(np.append(True, group[1:] != group[:-1])), len(group))
        out = []
        for a, b in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
            domain = token[a:b]
            signature, upper = _signature(self.tokens[domain]), min(1 << (len(domain) - 1).bit_length(), self.words[group[a]])
            bands: dict[int, np.ndarray] = {}
            for i in self.groups[group[a]]:
                rows = band_rows(int(self.sizes[i]), upper, self.percent)
                if rows not in bands:
                    bands[rows] = _bands(signature, rows)
                if (bands[rows] == self.table(i, rows)).any():  # a candidate
                    shared = len(np.intersect1d(self.parts[i], domain, assume_unique=True))
                    if 100 * shared >= self.percent * self.sizes[i]:
                        out.append((i, shared))
        return out


def blocks(items: DataFrame) -> Iterator[tuple[list, list[str]]]:
    """The items in blocks of bounded size; no more than one block is held on the driver."""
    ids, texts, size = [], [], 0
    for r in items.where(F.col("text").isNotNull()).select("item_id", "text").toLocalIterator():
        more = len(r["text"].encode("utf-8", "surrogatepass"))
        if ids and (len(ids) == BLOCK_ITEMS or size + more > BLOCK_BYTES):
            yield ids, texts
            ids, texts, size = [], [], 0
        ids.append(r["item_id"])
        texts.append(r["text"])
        size += more
    if ids:
        yield ids, texts


def contained_items(docs: DataFrame, items: DataFrame, percent: int = 75) -> DataFrame:
    """doc_id, item_id, n_item, n_shared, containment of every item (item_id, text) that a document (doc_id, text) contains.

    One scan of the documents for each block of items. Only pairs found are moved.
    """
    spark = docs.sparkSession
    ship_code(spark)
    types = [table.schema[c].dataType.simpleString() for table, c in ((docs, "doc_id"), (items, "item_id"))]
    schema = f"doc_id {types[0]}, item_id {types[1]}, n_item long, n_shared long, containment double"
    found = None
    for ids, texts in blocks(items):
        sent = spark.sparkContext.broadcast((ids, texts))

        def search(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            index = ItemIndex(*sent.value, percent)
            for batch in batches:
                row, out = [], ([], [], [], [])
                for i, text in enumerate(texts_of(batch.column(1))):
                    for item, shared in index.search(text):
                        row.append(i)
                        size = int(index.sizes[item])
                        for column, value in zip(out, (index.ids[item], size, shared, shared / size), strict=True):
                            column.append(value)
                if row:
                    columns = [pa.array(x) for x in out]
                    yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(row)), *columns], names=["doc_id", "item_id", "n_item", "n_shared", "containment"])

        part = docs.select("doc_id", "text").mapInArrow(tidy(search), schema)
        found = part if found is None else found.unionByName(part)
    if found is None:
        return spark.createDataFrame([], schema)
    best = F.max(F.struct("containment", "n_shared", "n_item")).alias("x")
    return found.groupBy("doc_id", "item_id").agg(best).select("doc_id", "item_id", "x.n_item", "x.n_shared", "x.containment")
