"""Language identification by rank-order profiles.

A language's profile is the ranking of its most frequent letter n-grams (1 to 3 letters, a blank at both ends of a word) in
all training texts. A document's own most frequent n-grams are compared with each profile: the out-of-place distance sums
how far each n-gram's rank is from its rank there, or the largest distance where the profile lacks it. The nearest language
wins, ties go to the alphabetically first. The score is 1 minus the distance as a share of the largest possible one.

Letters are the characters that Unicode has in a letter category; of other ones, runs count as one blank. N-grams of equal
frequency are ranked alphabetically by code point, in profiles and documents alike.

A null text, or one without a letter, is `und` with score 0, and so is every text if nothing could be learned. Texts of any
length are read whole, in pieces. Repeated rows get one result each. An empty table gives an empty result. Other columns are not
read, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lumaframe.llm.words import texts_of, tidy
from lumaframe.session import ship_code

RANKS = 400
#: Characters of a text that are read at once, and different n-grams that a task holds at most.
PIECE, HELD_GRAMS = 1 << 18, 1 << 20
#: Characters of training texts that are counted together.
BATCH_CHARS = 1 << 20
_BITS, _BLANK = np.uint64(21), 32


@cache
def _letters() -> np.ndarray:
    """Each code point, or a blank for what is no letter."""
    return np.array([c if chr(c).isalpha() else _BLANK for c in range(0x110000)], np.uint64)


def gram_codes(text: str) -> np.ndarray:
    """The n-grams of 1 to 3 letters of a text, repeats included, as numbers in alphabetical order: 21 bits a character."""
    c = _letters()[np.frombuffer(f" {text} ".encode("utf-32-le", "surrogatepass"), np.uint32)]
    is_letter = c != _BLANK
    high, middle = c << (_BITS * np.uint64(2)), c << _BITS
    two = is_letter[:-1] | is_letter[1:]
    three = is_letter[1:-1]
    return np.concatenate([high[is_letter], (high[:-1] | middle[1:])[two], (high[:-2] | middle[1:-1] | c[2:])[three]])


def _counted(codes: np.ndarray, counts: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Different codes in order, and how often each comes."""
    if counts is not None:
        order = np.argsort(codes, kind="stable")
        codes, counts = codes[order], counts[order]
    else:
        codes = np.sort(codes)
    first = np.flatnonzero(np.append(True, codes[1:] != codes[:-1])) if len(codes) else np.empty(0, np.int64)
    total = np.diff(np.append(first, len(codes))) if counts is None else np.add.reduceat(counts, first) if len(first) else counts
    return codes[first], total


def gram_counts(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Different n-grams of a text and their frequencies. Long texts are cut before blanks, which no n-gram has in its middle."""
    text = text.lower()
    if len(text) <= PIECE:
        return _counted(gram_codes(text))
    found, a = (np.empty(0, np.uint64), np.empty(0, np.int64)), 0
    while a < len(text):
        b = min(a + PIECE, len(text))
        while b < len(text) and text[b].isalpha():
            b += 1
        more = _counted(gram_codes(text[a:b]))
        found = _counted(np.concatenate([found[0], more[0]]), np.concatenate([found[1], more[1]]))
        a = b
    return found


def gram_text(code: int) -> str:
    return "".join(chr(c) for c in (code >> 42, (code >> 21) & 0x1FFFFF, code & 0x1FFFFF) if c)


def gram_code(gram: str) -> int:
    return sum(ord(c) << (42 - 21 * i) for i, c in enumerate(gram))


def profiles(train: DataFrame, ranks: int = RANKS) -> dict[str, list[str]]:
    """The ranked n-grams of each language in train (text, lang); the rows that reach the driver are `ranks` a language."""
    ship_code(train.sparkSession)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: dict[str, list[np.ndarray]] = {}
        held: dict[str, tuple[np.ndarray, np.ndarray]] = {}

        def turn(lang: str) -> None:
            codes, counts = _counted(np.concatenate(waiting.pop(lang)))
            before = held.get(lang, (codes[:0], counts[:0]))
            held[lang] = _counted(np.concatenate([before[0], codes]), np.concatenate([before[1], counts]))

        def flush() -> pa.RecordBatch:
            for lang in list(waiting):
                turn(lang)
            langs = [lang for lang, (codes, _) in held.items() for _ in codes]
            grams = [gram_text(code) for codes, _ in held.values() for code in codes.tolist()]
            counts = np.concatenate([np.empty(0, np.int64), *(n for _, n in held.values())])
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array(langs, pa.string()), pa.array(grams, pa.string()), pa.array(counts, pa.int64())], names=["lang", "gram", "n"])

        size = 0
        for batch in batches:
            for text, lang in zip(texts_of(batch.column(0)), texts_of(batch.column(1)), strict=True):
                if len(text) > PIECE:
                    codes, counts = gram_counts(text)
                    before = held.get(lang, (codes[:0], counts[:0]))
                    held[lang] = _counted(np.concatenate([before[0], codes]), np.concatenate([before[1], counts]))
                else:
                    waiting.setdefault(lang, []).append(gram_codes(text.lower()))
                    size += len(text)
                if size >= BATCH_CHARS:
                    size = 0
                    for waits in list(waiting):
                        turn(waits)
                    if sum(len(codes) for codes, _ in held.values()) > HELD_GRAMS:
                        yield flush()
        yield flush()

    counted = train.where("text is not null and lang is not null").select("text", "lang").mapInArrow(tidy(count), "lang string, gram string, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    best = Window.partitionBy("lang").orderBy(F.desc("n"), "gram")
    rows = counted.withColumn("r", F.row_number().over(best)).where(F.col("r") <= ranks).orderBy("lang", "r").collect()
    found: dict[str, list[str]] = {}
    for r in rows:
        found.setdefault(r["lang"], []).append(r["gram"])
    return found


class Ranker:
    """Predicts a text's language from profiles."""

    def __init__(self, known: dict[str, list[str]], ranks: int = RANKS) -> None:
        self.langs, self.ranks = sorted(known), ranks
        codes = {lang: np.array([gram_code(g) for g in known[lang]], np.uint64) for lang in self.langs}
        self.codes = np.unique(np.concatenate([np.empty(0, np.uint64), *codes.values()]))
        # One column for each n-gram that a profile has, and one for all others.
        self.places = np.full((len(self.langs), len(self.codes) + 1), -1, np.int64)
        for i, lang in enumerate(self.langs):
            self.places[i, np.searchsorted(self.codes, codes[lang])] = np.arange(len(codes[lang]))

    def predict(self, text: str | None) -> tuple[str, float]:
        if not text or not self.langs:
            return "und", 0.0
        codes, counts = gram_counts(text)
        if not len(codes):
            return "und", 0.0
        top = codes[np.argsort(-counts, kind="stable")[: self.ranks]]
        at = np.searchsorted(self.codes, top)
        at[at == len(self.codes)] = 0
        places = self.places[:, np.where(self.codes[at] == top, at, len(self.codes))]
        apart = np.where(places < 0, self.ranks, np.abs(places - np.arange(len(top)))).sum(axis=1)
        best = int(np.argmin(apart))
        return self.langs[best], float(1 - apart[best] / (self.ranks * len(top)))


def predict_language(docs: DataFrame, known: dict[str, list[str]], ranks: int = RANKS) -> DataFrame:
    """doc_id, lang_pred, score of docs (doc_id, text)."""
    ship_code(docs.sparkSession)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ranker = Ranker(known, ranks)
        for batch in batches:
            found = [ranker.predict(t) for t in texts_of(batch.column(1))]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([x[0] for x in found], pa.string()), pa.array([x[1] for x in found], pa.float64())], names=["doc_id", "lang_pred", "score"])

    key = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(tidy(score), f"doc_id {key}, lang_pred string, score double")


def fold(folds: int) -> Column:
    """crc32 of the doc_id's text form, modulo folds."""
    return F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(folds))


def language_id(docs: DataFrame, folds: int = 4, held_out: int = 2) -> DataFrame:
    """Learn from the rows outside the held-out fold that have a lang, predict every row: doc_id, held_out, lang_pred, score."""
    known = profiles(docs.where(fold(folds) != held_out))
    return predict_language(docs, known).select("doc_id", (fold(folds) == held_out).alias("held_out"), "lang_pred", "score")
