"""Secret scans: three patterns, and a battery of randomness tests for tokens that no pattern names.

DataFrame functions only.

* Base spans are the leftmost non-overlapping matches of each pattern. The pieces between matches and the matches
  themselves give the positions, so a text is not searched for what was found.
* Candidates are all tokens of 20 or more characters, and of those that base spans touch what is left beside the spans,
  if it is as long. The boundaries of tokens and spans of a text are rows in one order, and running counts tell what lies
  in a token and in no span: no token is compared with all spans of its text. The
  encoding is inferred (hexadecimal, base 32, base 36, base 64), symbols become their numbers in its alphabet, and three
  tests of the hypothesis "uniformly random" are made: chi-squared over equal ranges of the alphabet, the runs above
  and below its middle, and the serial correlation of neighbours. The smallest p-value, times three, stands for all.
* A word or an identifier is far from random. Which candidates are declared so is controlled over the whole table:
  Benjamini-Hochberg at rate ``FDR`` within each encoding and band of lengths, as short tokens have far less power and
  must not set the threshold for long ones. Of the truly random tokens at most that share of the discarded is lost.
  What is not discarded is a span of kind ``random``. The ranking is done on a histogram of p-values with a bounded
  number of bins, so no group is sorted in one task.

What is found is written once to the shared folder, without the texts. The work grows with the length of a text, and its
logarithm, however many spans it holds. Defined results: null is an empty text; a text
without spans has the digest of the empty string and empty ``spans``. Rows that repeat are scanned one by one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from newsmood.llm.common import free_name, id_and_text
from newsmood.sources.shared import materialise

ASSIGN = (r"((?i:password|passwd|secret|token|api_?key))[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)")
ACCESS = r"AKIA[A-Z0-9]{14,}"  # of AKIA[A-Z0-9]+ only runs of 18 or more count
HEX = r"[0-9a-f]{16,}"
TOKEN = r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{20,}={0,2}"
REST = r"^[A-Za-z0-9+/_-]{20,}={0,2}$"
KINDS = ("assign", "access", "hex", "random")
FDR = 0.05
CHUNK = 256  # matches whose positions are added up in one fold
PIECE = 4096  # characters of a text that are masked at a time
BINS_PER_DECADE, BINS = 20, 400
BANDS = (32, 48, 80)  # lengths at which a new band begins

LOWER, UPPER, DIGITS = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789"
#: encoding: what a token of it looks like, its alphabet. The first that fits is inferred.
ENCODINGS = {
    "hex": (r"^([0-9a-f]+|[0-9A-F]+)$", DIGITS + "abcdef"),
    "base32": (r"^[A-Z2-7]+=*$", UPPER + "234567"),
    "base36": (r"^([0-9a-z]+|[0-9A-Z]+)$", DIGITS + LOWER),
    "base64": (r"", UPPER + LOWER + DIGITS + "+/"),
}


def _found(text: Column, pattern: str) -> Column:
    none = F.array().cast("array<string>")
    return F.when(text.rlike(pattern), F.regexp_extract_all(text, F.lit(pattern), F.lit(0))).otherwise(none)


def located(rows: DataFrame, pattern: str, name: str) -> DataFrame:
    """``rows`` (with ``text``) and the matches of a pattern as array<struct<start, end, found>> in column ``name``.

    Gaps and matches are added up in chunks, so that a text with very many matches takes linear time.
    """
    gaps = F.when(F.size("__found") > 0, F.split("text", pattern, -1)).otherwise(F.array().cast("array<string>"))
    pairs = F.zip_with(F.slice(gaps, F.lit(1), F.size("__found")), F.col("__found"),
                       lambda g, m: F.struct(F.length(g).alias("gap"), F.length(m).alias("size"), m.alias("found")))
    chunks = F.transform(F.sequence(F.lit(0), F.floor((F.size("__pairs") - 1) / CHUNK).cast("int")),
                         lambda i: F.slice("__pairs", i * CHUNK + 1, F.lit(CHUNK)))
    chunks = F.when(F.size("__pairs") > 0, chunks).otherwise(F.array(F.col("__pairs")))
    total = F.transform("__chunks", lambda c: F.aggregate(
        c, F.lit(0), lambda at, x: (at + x["gap"] + x["size"]).cast("int")))
    out_type = "array<struct<start:int,end:int,found:string>>"

    def positions(chunk: Column, i: Column) -> Column:
        begin = F.aggregate(F.slice("__total", F.lit(1), i), F.lit(0), lambda at, n: (at + n).cast("int"))
        return F.aggregate(
            chunk, F.struct(begin.alias("at"), F.array().cast(out_type).alias("out")),
            lambda done, x: F.struct(
                (done["at"] + x["gap"] + x["size"]).cast("int").alias("at"),
                F.concat(done["out"], F.array(F.struct(
                    (done["at"] + x["gap"]).cast("int").alias("start"),
                    (done["at"] + x["gap"] + x["size"]).cast("int").alias("end"), x["found"].alias("found"))))
                .alias("out")),
            lambda done: done["out"])

    return (rows.withColumn("__found", _found(F.col("text"), pattern)).withColumn("__pairs", pairs)
            .withColumn("__chunks", chunks).withColumn("__total", total)
            .withColumn(name, F.flatten(F.transform("__chunks", positions)))
            .drop("__found", "__pairs", "__chunks", "__total"))


def _as_spans(matches: str, kind: str) -> Column:
    return F.transform(matches, lambda m: F.struct(
        m["start"].alias("start"), F.lit(KINDS.index(kind)).alias("rank"), m["end"].alias("end")))


def _joined(spans: Column) -> Column:
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(F.array_sort(spans), lambda s: F.concat_ws(
        ":", F.element_at(names, s["rank"] + 1), s["start"].cast("string"), s["end"].cast("string"))), ",")


def base_spans(docs: DataFrame) -> DataFrame:
    """(doc_id, base, token): spans of the patterns, and the tokens with their texts."""
    rows = id_and_text(docs)
    for name, pattern in (("assign", ASSIGN), ("access", ACCESS), ("hex", HEX), ("token", TOKEN)):
        rows = located(rows, pattern, name)
    value = lambda m: F.regexp_extract(m["found"], ASSIGN, 2)
    rows = rows.withColumn("assign", F.filter("assign", lambda m: F.length(value(m)) >= 12))
    return rows.select("doc_id", F.concat(*[_as_spans(k, k) for k in KINDS[:3]]).alias("base"), "token")


def candidates(rows: DataFrame) -> DataFrame:
    """(row, start, end, found): the tokens of ``rows`` (row, base, token) less the base spans, where enough is left."""
    alone = rows.where(F.size("base") == 0).select("row", F.explode("token").alias("t")).select("row", "t.*")

    def marks(spans: str, edge: str, token: int, base: int) -> Column:
        opens = token == 1
        return F.transform(spans, lambda x: F.struct(
            x[edge].alias("at"), F.lit(token).alias("token"), F.lit(base).alias("base"),
            (x["found"] if opens else F.lit(None).cast("string")).alias("found"),
            (x["start"] if opens else F.lit(None).cast("int")).alias("from")))

    every = F.concat(marks("token", "start", 1, 0), marks("token", "end", -1, 0), marks("base", "start", 0, 1),
                     marks("base", "end", 0, -1))
    edges = (rows.where((F.size("base") > 0) & (F.size("token") > 0)).select("row", F.explode(every).alias("e"))
             .select("row", "e.*").groupBy("row", "at").agg(
                 F.sum("token").alias("token"), F.sum("base").alias("base"), F.max("found").alias("found"),
                 F.max("from").alias("from")))
    order = Window.partitionBy("row").orderBy("at")  # the boundaries within one text
    parts = edges.select(
        "row", "at", F.lead("at").over(order).alias("until"), F.sum("token").over(order).alias("in_token"),
        F.sum("base").over(order).alias("in_base"), F.last("found", True).over(order).alias("found"),
        F.last("from", True).over(order).alias("from"))
    left = parts.where("in_token > 0 AND in_base = 0").select(
        "row", F.col("at").alias("start"), F.col("until").alias("end"),
        F.expr("substring(found, at - from + 1, until - at)").alias("found"))
    return alone.unionByName(left.where(F.col("found").rlike(REST)))


def upper_tail(z: Column) -> Column:
    """P(N(0, 1) > z) for any z (Abramowitz and Stegun 26.2.17, absolute error below 1e-7)."""
    t = 1 / (1 + 0.2316419 * F.abs(z))
    poly = t * (0.319381530 + t * (-0.356563782 + t * (1.781477937 + t * (-1.821255978 + t * 1.330274429))))
    tail = F.exp(-z * z / 2) * 0.3989422804014327 * poly
    return F.when(z >= 0, tail).otherwise(1 - tail)


def battery(tokens: DataFrame) -> DataFrame:
    """``tokens`` (with ``found``) and encoding, band, p: the battery's p-value of "random", between 0 and 1."""
    found = F.col("found")
    kind, alphabet = F.lit(None).cast("string"), F.lit(None).cast("string")
    for name, (looks, letters) in reversed(ENCODINGS.items()):
        kind = F.when(found.rlike(looks), name).otherwise(kind)
        alphabet = F.when(found.rlike(looks), letters).otherwise(alphabet)
    plain = F.translate(F.regexp_replace(found, "=+$", ""), "-_", "+/")
    plain = F.when(F.col("encoding") == "hex", F.lower(plain)).when(
        (F.col("encoding") == "base36") & ~found.rlike("[a-z]"), F.lower(plain)).otherwise(plain)
    n, a = F.col("n"), F.length("alphabet")
    codes = F.transform(F.split("plain", ""), lambda c: F.call_function("locate", c, F.col("alphabet")) - 1)
    rows = (tokens.withColumn("encoding", kind).withColumn("alphabet", alphabet).withColumn("plain", plain)
            .withColumn("codes", codes).withColumn("n", F.size("codes").cast("double")))
    total = lambda xs, f: F.aggregate(xs, F.lit(0.0), lambda s, x: s + f(x))

    # chi-squared over ranges of the alphabet that expect at least some three symbols each
    ranges = F.when(n < 24, 4).when(n < 48, 8).otherwise(16)
    seen = F.transform(F.sequence(F.lit(0), ranges - 1), lambda r: F.size(F.filter(
        "codes", lambda c: F.floor(c * ranges / a) == r)).cast("double"))
    width = lambda r: F.ceil((r + 1) * a / ranges) - F.ceil(r * a / ranges)  # noqa: E731  symbols in a range
    expected = F.transform(F.sequence(F.lit(0), ranges - 1), lambda r: n * width(r) / a)
    chi = total(F.zip_with(seen, expected, lambda s, e: (s - e) * (s - e) / e), lambda x: x)
    free = (ranges - 1).cast("double")  # Wilson and Hilferty: the cube root is nearly normal
    chi_p = upper_tail((F.pow(chi / free, F.lit(1 / 3)) - (1 - 2 / (9 * free))) / F.sqrt(2 / (9 * free)))

    # runs above and below the middle
    high = F.transform("codes", lambda c: c * 2 >= a)
    up = F.size(F.filter(high, lambda x: x)).cast("double")
    down = n - up
    pairs = F.zip_with(F.slice("codes", F.lit(1), F.size("codes") - 1), F.slice("codes", F.lit(2), F.size("codes") - 1),
                       lambda x, y: F.struct(x.alias("x"), y.alias("y")))
    runs = 1 + F.size(F.filter(pairs, lambda p: (p["x"] * 2 >= a) != (p["y"] * 2 >= a)))
    runs_mean = 2 * up * down / n + 1
    runs_var = (runs_mean - 1) * (runs_mean - 2) / (n - 1)
    runs_p = F.when(runs_var > 0, 2 * upper_tail(F.abs(runs - runs_mean) / F.sqrt(runs_var))).otherwise(0.0)

    # serial correlation of neighbours
    mean = total(F.col("codes"), lambda c: c) / n
    spread = total(F.col("codes"), lambda c: (c - mean) * (c - mean))
    serial = total(pairs, lambda p: (p["x"] - mean) * (p["y"] - mean))
    serial_p = F.when(spread > 0, 2 * upper_tail(F.abs(serial / spread + 1 / n) * F.sqrt(n))).otherwise(0.0)

    band = F.lit(0)
    for at in BANDS:
        band = band + (F.length("found") >= at).cast("int")
    return (rows.withColumn("p", F.least(F.lit(1.0), 3 * F.least(chi_p, runs_p, serial_p)))
            .withColumn("band", band).drop("alphabet", "plain", "codes", "n"))


def not_random(tested: DataFrame, rate: float = FDR) -> DataFrame:
    """(encoding, band, bin): up to this bin of p-values tokens of the group are declared not random.

    Bins count from p = 1 downwards. A bin passes by its largest p-value against the tokens at or below it, so the
    control holds for every token in it. At most one row for each encoding and band.
    """
    counted = tested.groupBy("encoding", "band", p_bin().alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    group = Window.partitionBy("encoding", "band")
    below = group.orderBy(F.desc("bin")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    largest = F.pow(F.lit(10.0), -F.col("bin") / BINS_PER_DECADE)
    ranked = counted.withColumn("at_most", F.sum("n").over(below)).withColumn("m", F.sum("n").over(group))
    return (ranked.where(largest <= rate * F.col("at_most") / F.col("m"))
            .groupBy("encoding", "band").agg(F.min("bin").alias("from_bin")))


def p_bin() -> Column:
    return F.least(F.lit(BINS), F.floor(-F.log10(F.greatest("p", F.lit(1e-30))) * BINS_PER_DECADE)).cast("int")


def scan(docs: DataFrame, rate: float = FDR) -> DataFrame:
    """One row per document: doc_id, base and spans as arrays of (start, rank of the kind, end)."""
    rows = materialise(base_spans(docs).withColumn("row", F.monotonically_increasing_id()), "secrets")
    tested = materialise(battery(candidates(rows)).drop("found"), "battery")
    limits = not_random(tested, rate)
    # the limits are one row for each encoding and band: 16 at most
    kept = (tested.join(F.broadcast(limits), ["encoding", "band"], "left")
            .where(F.col("from_bin").isNull() | (p_bin() < F.col("from_bin")))
            .groupBy("row").agg(F.collect_list(F.struct(
                "start", F.lit(KINDS.index("random")).alias("rank"), "end")).alias("more")))
    spans = F.concat("base", F.coalesce("more", F.array().cast("array<struct<start:int,rank:int,end:int>>")))
    return rows.join(kept, "row", "left").select("doc_id", "base", spans.alias("spans"))


def summary(docs: DataFrame, rate: float = FDR) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans."""
    def of_kind(rank: int) -> Column:
        return F.size(F.filter("base", lambda s: s["rank"] == rank)).cast("long")

    counts = [of_kind(rank).alias(f"n_{kind}") for rank, kind in enumerate(KINDS[:3])]
    return scan(docs, rate).select("doc_id", *counts, F.sha2(_joined(F.col("base")), 256).alias("base_sha256"),
                                   _joined(F.col("spans")).alias("spans"))


def redact(docs: DataFrame, rate: float = FDR, text_col: str = "text", mark: str = "[SECRET]") -> DataFrame:
    """The documents with each span, or run of overlapping spans, replaced by ``mark``. All other columns stay.

    The rows are stored once, each with a key of its own that brings its spans back to it: ids may repeat, with equal
    or other texts, or be null. A text without spans, a null one too, stays as it is.
    """
    key, at_spans = free_name(docs, "found_row"), free_name(docs, "found_spans")
    stored = materialise(docs.withColumn(key, F.monotonically_increasing_id()), "to-redact")
    found = (scan(stored.select(F.col(key).alias("doc_id"), F.col(text_col).alias("text")), rate)
             .where(F.size("spans") > 0).select(F.col("doc_id").alias(key), F.col("spans").alias(at_spans)))
    order = Window.partitionBy(key).orderBy("start", "end")  # the spans of one text
    spans = found.select(key, F.explode(at_spans).alias("s")).select(key, "s.start", "s.end")
    before = F.max("end").over(order.rowsBetween(Window.unboundedPreceding, -1))
    runs = (spans.withColumn("opens", F.coalesce(F.col("start") > before, F.lit(True)).cast("int"))
            .withColumn("run", F.sum("opens").over(order)).groupBy(key, "run")
            .agg(F.min("start").alias("start"), F.max("end").alias("end")))
    first = F.expr(f"start div {PIECE}")
    cuts = (runs.select(key, "start", "end", F.explode(F.sequence(first, F.expr(f"(end - 1) div {PIECE}"))).alias("piece"))
            .groupBy(key, "piece").agg(F.array_sort(F.collect_list(F.struct(
                F.greatest(F.col("start") - F.col("piece") * PIECE, F.lit(0)).cast("int").alias("start"),
                F.least(F.col("end") - F.col("piece") * PIECE, F.lit(PIECE)).cast("int").alias("end"),
                (first == F.col("piece")).alias("opens")))).alias("cuts")))
    # the cuts of a text by piece, each with the number of pieces without any before it
    before = F.coalesce(F.lag("piece").over(Window.partitionBy(key).orderBy("piece")), F.lit(-1))
    of_text = (cuts.withColumn("skip", (F.col("piece") - before - 1).cast("int")).groupBy(key)
               .agg(F.array_sort(F.collect_list(F.struct("piece", "skip", "cuts"))).alias(at_spans)))

    def masked(part: Column, cuts: Column) -> Column:
        at = lambda i: F.element_at(cuts, i)
        # what stands before the first cut of a piece, between two, and after the last; a run that goes on has one mark
        kept = F.transform(F.sequence(F.lit(0), F.size(cuts)), lambda i: F.concat(
            F.when((i > 0) & at(F.greatest(i, F.lit(1)))["opens"], mark).otherwise(""),
            F.substring(part, F.when(i == 0, 0).otherwise(at(F.greatest(i, F.lit(1)))["end"]) + 1,
                        F.when(i == F.size(cuts), PIECE).otherwise(at(F.least(i + 1, F.size(cuts)))["start"])
                        - F.when(i == 0, 0).otherwise(at(F.greatest(i, F.lit(1)))["end"]))))
        return F.when(cuts.isNull(), part).otherwise(F.array_join(kept, ""))

    joined = stored.join(of_text, key, "left")
    pieces = F.regexp_extract_all(F.col(text_col), F.lit(f"(?s).{{1,{PIECE}}}"), F.lit(0))
    none = F.lit(None).cast(cuts.schema["cuts"].dataType)
    by_piece = F.flatten(F.transform(at_spans, lambda x: F.concat(F.array_repeat(none, x["skip"]), F.array(x["cuts"]))))
    clean = F.array_join(F.zip_with(pieces, by_piece, masked), "")
    return joined.withColumn(text_col, F.when(F.col(at_spans).isNull(), F.col(text_col)).otherwise(clean)).select(
        *docs.columns)
