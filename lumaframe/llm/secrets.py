"""Secret scan in DataFrame functions only: three fixed patterns and a battery of randomness tests.

The patterns give the spans of kind assign, access and hex. The battery adds spans of kind random: every other run of 20 or
more characters of an encoding's alphabet that is too random to be a word or a number that someone wrote. Per run, the encoding is
inferred (decimal, hex, base32, letters and digits in base64), and three tests give p-values under the encoding's null model:
- chi-squared of the alphabet's uniformity: a low value is improbable if characters come as unevenly as in language, or, for
  digits, as in written numbers with their zeros and repeats,
- a runs test on character classes (for decimals, the low and the high digits): many changes between classes are improbable,
- serial correlation of neighbouring codes: counters, repeated and ordered characters correlate strongly, a value near 0 is
  improbable for them; where it is too large for chance, the run is let go at once.
The p-values are combined (Fisher, six degrees of freedom). Over all runs of all texts, false discoveries are controlled by the
Benjamini-Hochberg rule within each class of lengths, for short runs are many and have little power. Only the counts of
p-values by length class and bin reach the driver, a fixed number of them at most.

A null text is empty: no spans, the digest of an empty list. Repeated rows are scanned each. Positions count code points. Texts
of any length are scanned whole; sums over their matches are made block by block, so no array grows match by match. An empty table
gives an empty result. redact() keeps all columns and their order, whatever their names.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The patterns, their least lengths and the order of kinds.
ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"
KINDS = ("assign", "access", "hex", "random")
ASSIGN_LEAST = 6

RUN = r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{20,}+={0,2}"
#: Encodings in order of inference: pattern, alphabet, and under the null model the chance that two characters are equal and
#: that neighbours differ in class.
ENCODINGS = (
    (r"^[0-9]+$", "0123456789", 0.16, 0.35),
    (r"^[0-9a-fA-F]+$", "0123456789abcdef", 0.11, 0.2),
    (r"^[A-Z2-7]+=*$", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567", 0.06, 0.12),
    (r"^.*$", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_-", 0.06, 0.12),
)
#: Standard deviation of the serial correlation's z under the null model, and the |z| beyond which a run is let go.
SERIAL, REGULAR = 2.5, 3.5
#: Matches of a text that are summed together.
BLOCK = 64
LENGTH_CLASSES = (20, 28, 40, 64, 128)
#: False discoveries among the runs taken, p-values in bins of so many to a power of ten, and the last bin.
RATE, BINS, LAST_BIN = 0.01, 20, 400


def _let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with value computed once."""
    return F.element_at(F.transform(F.array(value), use), 1)


def _running(values: Column, add: Callable[[Column, Column], Column], zero: int) -> Column:
    """For each of an array's ints the total (by add) of those before it: blocks first, then inside the blocks."""
    total = lambda x: F.aggregate(x, F.lit(zero), add)

    def inside(block: Column, before: Column) -> Column:
        return F.transform(F.sequence(F.lit(0), F.size(block) - 1), lambda i: add(before, total(F.slice(block, 1, i))))

    def of(values: Column) -> Column:
        blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size(values) - 1) / BLOCK).cast("int")), lambda k: F.slice(values, k * BLOCK + 1, BLOCK))
        return _let(blocks, lambda b: _let(F.transform(b, total), lambda sums: F.flatten(F.transform(b, lambda x, k: inside(x, total(F.slice(sums, 1, k)))))))

    return _let(values, lambda v: F.when(F.size(v) > 0, of(v)).otherwise(F.expr("cast(array() as array<int>)")))


def _add(a: Column, b: Column) -> Column:
    return a + b


def _larger(a: Column, b: Column) -> Column:
    return F.greatest(a, b)


def _smaller(a: Column, b: Column) -> Column:
    return F.least(a, b)


def _spans(matches: Column, gaps: Column, kind: str) -> Column:
    """(start, order, end, kind, match) of each match, from the matches and what stands between them."""
    pairs = F.zip_with(F.slice(gaps, 1, F.size(matches)), matches, lambda g, m: F.struct(F.length(g).alias("g"), F.length(m).alias("m"), m.alias("text")))

    def placed(x: Column, before: Column) -> Column:
        start = before + x["g"]
        return F.struct(start.alias("start"), F.lit(KINDS.index(kind)).alias("rank"), (start + x["m"]).alias("end"), F.lit(kind).alias("kind"), x["text"].alias("text"))

    return _let(pairs, lambda p: F.zip_with(p, _running(F.transform(p, lambda x: x["g"] + x["m"]), _add, 0), placed))


def _found(text: Column, pattern: str, kind: str) -> Column:
    """The spans of a pattern's matches; texts without one cost a single search."""
    none = F.expr("cast(array() as array<struct<start:int,rank:int,end:int,kind:string,text:string>>)")
    spans = _spans(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.split(text, pattern, -1), kind)
    if kind == "assign":
        values = F.regexp_extract_all(text, F.lit(pattern), F.lit(2))
        long = F.zip_with(spans, values, lambda s, v: F.when(F.length(v) >= ASSIGN_LEAST, s))
        spans = F.filter(long, lambda s: s.isNotNull())
    return F.when(text.rlike(pattern), spans).otherwise(none)


def _lower_tail(z: Column) -> Column:
    """Normal distribution function, by a logistic approximation whose tails are rather too small than too large in effect."""
    return 1 / (1 + F.exp(-F.least(F.greatest(1.5976 * z + 0.070566 * z * z * z, F.lit(-600.0)), F.lit(600.0))))


def _score(run: Column) -> Column:
    """-log10 of the combined p-value of a run being language, in bins; -1 if the serial correlation shows a regular sequence."""
    body = F.regexp_replace(run, "=+$", "")
    model = F.struct(*(F.lit(x) for x in ENCODINGS[-1][1:]))
    for pattern, *values in reversed(ENCODINGS[:-1]):
        model = F.when(body.rlike(pattern), F.struct(*(F.lit(x) for x in values))).otherwise(model)
    plain = F.when(body.rlike(ENCODINGS[1][0]), F.lower(body)).otherwise(body)
    halves = F.translate(body, ENCODINGS[0][1], "0" * 5 + "5" * 5)
    classes = F.when(body.rlike(ENCODINGS[0][0]), halves).otherwise(F.translate(body, ENCODINGS[-1][1], "A" * 26 + "a" * 26 + "0" * 10 + "+" * 4))

    def battery(codes: Column, letters: Column, coincidence: Column, expected_changes: Column, kinds: Column) -> Column:
        n, k = F.size(codes).cast("double"), F.length(letters)
        counts = F.transform(F.sequence(F.lit(1), k), lambda s: F.size(F.filter(codes, lambda c: c == s)).cast("double"))
        squares = F.aggregate(counts, F.lit(0.0), lambda a, c: a + c * c)
        chi = k * squares / n - n
        # Under the null model chi-squared is larger by n * (k * coincidence - 1); its spread follows from that of pairs and of letters.
        expected = (n - 1) * (k * coincidence - 1) + k - 1
        pairs = n * (n - 1) / 2
        spread = 2 * k / n * F.sqrt(pairs * coincidence * (1 - coincidence) + F.pow(n, F.lit(3.0)) * 0.0017)
        by_chi = _lower_tail((chi - expected) / spread)
        changes = F.aggregate(F.sequence(F.lit(2), F.size(kinds)), F.lit(0.0), lambda a, i: a + (F.element_at(kinds, i) != F.element_at(kinds, i - 1)).cast("double"))
        by_runs = _lower_tail(((n - 1) * expected_changes + 0.5 - changes) / F.sqrt((n - 1) * expected_changes * (1 - expected_changes)))
        mean = F.aggregate(codes, F.lit(0.0), lambda a, c: a + c) / n
        power = F.aggregate(codes, F.lit(0.0), lambda a, c: a + (c - mean) * (c - mean))
        serial = F.aggregate(F.sequence(F.lit(2), F.size(codes)), F.lit(0.0), lambda a, i: a + (F.element_at(codes, i) - mean) * (F.element_at(codes, i - 1) - mean))
        z = F.abs(serial / F.greatest(power, F.lit(1e-9))) * F.sqrt(n)
        by_serial = F.greatest(2 * _lower_tail(z / SERIAL) - 1, F.lit(1e-3))
        fisher = sum((-F.log(F.greatest(p, F.lit(1e-300))) for p in (by_chi, by_runs, by_serial)), F.lit(0.0))
        log10 = _let(fisher, lambda x: (x - F.log(1 + x + x * x / 2)) / 2.302585093)
        return F.when((power == 0) | (z > REGULAR), F.lit(-1)).otherwise(F.least(F.floor(log10 * BINS), F.lit(LAST_BIN)).cast("int"))

    codes = lambda m: F.transform(F.split(plain, ""), lambda c: F.position(c, m["col1"]))
    inputs = _let(model, lambda m: F.struct(codes(m).alias("codes"), m.alias("model"), F.split(classes, "").alias("kinds")))
    return _let(inputs, lambda x: battery(x["codes"], x["model"]["col1"], x["model"]["col2"], x["model"]["col3"], x["kinds"]))


def _length_class(n: Column) -> Column:
    return F.expr("0") + sum((n >= least).cast("int") for least in LENGTH_CLASSES[1:])


def _candidates(text: Column) -> Column:
    """Runs with their length class and bin."""
    return F.transform(_found(text, RUN, "random"), lambda s: F.struct(s["start"].alias("start"), s["rank"].alias("rank"), s["end"].alias("end"), s["kind"].alias("kind"), _length_class(s["end"] - s["start"]).alias("size"), _score(s["text"]).alias("bin")))


def thresholds(docs: DataFrame) -> dict[int, int]:
    """Per length class the lowest bin that Benjamini-Hochberg takes, over the runs of all texts; classes without one are left out."""
    runs = docs.where(F.col("text").rlike(RUN)).select(F.explode(_candidates(F.col("text"))).alias("r")).groupBy("r.size", "r.bin").agg(F.count("*").alias("n"))
    total, taken = {}, {}
    rows = sorted(((r["size"], r["bin"], r["n"]) for r in runs.collect()), reverse=True)
    for size, _, n in rows:
        total[size] = total.get(size, 0) + n
    above: dict[int, int] = {}
    for size, b, n in rows:
        above[size] = above.get(size, 0) + n
        if b > 0 and 10 ** (-b / BINS) <= RATE * above[size] / total[size]:
            taken[size] = b
    return taken


def _free(base: Column, more: Column) -> Column:
    """Those of more that overlap none of base; both sorted by start. What overlaps a span begins before its end, or ends after its start."""
    every = F.array_sort(F.concat(F.transform(base, lambda s: F.struct(s["start"].alias("start"), F.lit(0).alias("more"), s.alias("span"))), F.transform(more, lambda s: F.struct(s["start"].alias("start"), F.lit(1).alias("more"), s.alias("span")))))
    last, never = F.lit(0), F.lit(2**31 - 1)

    def kept(every: Column) -> Column:
        ended = _running(F.transform(every, lambda x: F.when(x["more"] == 0, x["span"]["end"]).otherwise(last)), _larger, 0)
        begins = F.reverse(_running(F.reverse(F.transform(every, lambda x: F.when(x["more"] == 0, x["start"]).otherwise(never))), _smaller, 2**31 - 1))
        sides = F.zip_with(ended, begins, lambda e, b: F.struct(e.alias("ended"), b.alias("begins")))
        free = F.zip_with(every, sides, lambda x, y: F.when((x["more"] == 1) & (y["ended"] <= x["start"]) & (y["begins"] >= x["span"]["end"]), x["span"]))
        return F.filter(free, lambda s: s.isNotNull())

    return F.when((F.size(base) == 0) | (F.size(more) == 0), more).otherwise(_let(every, kept))


def with_spans(docs: DataFrame, lowest: dict[int, int] | None = None, column: str = "spans") -> DataFrame:
    """docs and one more column: all spans as (start, rank, end, kind), sorted by start and kind."""
    lowest = thresholds(docs) if lowest is None else lowest
    text = F.coalesce(F.col("text"), F.lit(""))
    base = F.array_sort(F.transform(F.concat(*(_found(text, p, k) for p, k in ((ASSIGN, "assign"), (ACCESS, "access"), (HEX, "hex")))), lambda s: F.struct(s["start"].alias("start"), s["rank"].alias("rank"), s["end"].alias("end"), s["kind"].alias("kind"))))
    least = F.lit(LAST_BIN + 1)
    taken = F.filter(_candidates(text), lambda s: s["bin"] >= _lowest(s["size"], lowest, least))
    more = F.transform(taken, lambda s: F.struct(s["start"].alias("start"), s["rank"].alias("rank"), s["end"].alias("end"), s["kind"].alias("kind")))
    placed = docs.withColumns({"_lf_base": base, "_lf_more": more})
    return placed.withColumn(column, F.array_sort(F.concat("_lf_base", _free(F.col("_lf_base"), F.col("_lf_more"))))).drop("_lf_base", "_lf_more")


def _lowest(size: Column, lowest: dict[int, int], otherwise: Column) -> Column:
    found = otherwise
    for k, b in lowest.items():
        found = F.when(size == k, F.lit(b)).otherwise(found)
    return found


def _listed(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat(s["kind"], F.lit(":"), s["start"].cast("string"), F.lit(":"), s["end"].cast("string"))), ",")


def _count(kind: str) -> Column:
    return F.size(F.filter("spans", lambda s: s["kind"] == kind))


def scan(docs: DataFrame) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans of every row of docs (doc_id, text)."""
    found = with_spans(docs.select("doc_id", "text"))
    counts = [_count(k).cast("long").alias(f"n_{k}") for k in KINDS]
    base = _listed(F.filter("spans", lambda s: s["kind"] != "random"))
    return found.select("doc_id", *counts[:3], F.sha2(base.cast("binary"), 256).alias("base_sha256"), _listed(F.col("spans")).alias("spans"), counts[3])


def redact(docs: DataFrame, mark: str = "[SECRET]") -> DataFrame:
    """docs with every span of its texts replaced by the mark, spans that overlap by one; null texts stay null."""
    found = with_spans(docs, column="_lf_spans")
    text = F.col("text")

    def pieces(groups: Column) -> Column:
        """What stands before each group and after the last: large pieces are cut from the text, small ones from these."""
        blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size(groups) - 1) / BLOCK).cast("int")), lambda k: F.slice(groups, k * BLOCK + 1, BLOCK))

        def cut(block: Column) -> Column:
            begin = block[0]["from"]
            whole = F.substring(text, begin + 1, F.element_at(block, -1)["upto"] - begin)
            return _let(whole, lambda w: F.transform(block, lambda g: F.substring(w, g["from"] - begin + 1, g["upto"] - g["from"])))

        return F.array_join(F.flatten(F.transform(blocks, cut)), mark)

    def clean(spans: Column) -> Column:
        # A group begins where all spans before have ended; before it stands what follows their ends.
        ended = _running(F.transform(spans, lambda s: s["end"]), _larger, 0)
        groups = F.filter(F.zip_with(spans, ended, lambda s, e: F.struct(e.alias("from"), s["start"].alias("upto"))), lambda g: g["upto"] >= g["from"])
        after = F.array(F.struct(F.array_max(F.transform(spans, lambda s: s["end"])).alias("from"), F.length(text).alias("upto")))
        return _let(F.concat(groups, after), pieces)

    return found.withColumn("text", F.when(F.size("_lf_spans") > 0, clean(F.col("_lf_spans"))).otherwise(text)).select(*docs.columns)
