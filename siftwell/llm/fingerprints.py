"""Document fingerprints by one-permutation MinHash, in DataFrame expressions only.

Each shingle is hashed once; the upper bits of its hash choose a bin, the least hash of a bin is its value.
An empty bin borrows by optimal densification: it asks bins in an order of its own, given by a hash of the
bin and the try, until one is not empty (after ``TRIES`` tries, the bin of least hash among those that are
not).  Of each value the ``BITS`` lowest bits are stored, eight values to a long.  The share of equal values
c overstates the likeness by chance hits, so it is corrected to (c - r) / (1 - r), r = 2 ** -BITS.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siftwell.llm.shared import pick

BINS, BITS = 128, 8
TRIES = 12
#: Ranges of ids that are ordered apart, at most; their first ids are all that the driver sees.
RANGES = 4096
_SPACES = " \t\n\x0b\x0c\r"


def _bin(x: Column) -> Column:
    return F.shiftrightunsigned(x, 64 - (BINS.bit_length() - 1)).cast("int")


def _bit(low: Column, high: Column, b: Column) -> Column:
    """Whether bin b is in the two halves of the mask."""
    return F.when(b < 64, F.getbit(low, b)).otherwise(F.getbit(high, F.greatest(b - 64, F.lit(0)))) == 1


def with_fingerprint(df: DataFrame, text: str, name: str, width: int = 5) -> DataFrame:
    """Adds ``name``: 16 longs of the text's fingerprint; null or blank text: an empty array."""
    t = {k: f"__{name}_{k}" for k in ("w", "s", "f", "lo", "hi", "src")}
    trimmed = F.btrim(F.coalesce(F.col(text), F.lit("")), F.lit(_SPACES))
    df = df.withColumn(t["w"], F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, r"[\x20\x09-\x0D]+")))
    w = F.col(t["w"])
    many = F.transform(F.sequence(F.lit(0), F.size(w) - width), lambda i: F.xxhash64(*(F.get(w, i + j) for j in range(width))))
    few = F.array(F.xxhash64(F.array_join(w, " "), F.lit(-1)))
    df = df.withColumn(t["s"], F.sort_array(F.when(F.size(w) >= width, many).when(F.size(w) > 0, few).otherwise(F.array().cast("array<bigint>")))).drop(t["w"])
    s = F.col(t["s"])
    df = df.withColumn(t["f"], F.filter(s, lambda x, i: (i == 0) | (_bin(x) != _bin(F.get(s, i - 1))))).drop(t["s"])
    f = F.col(t["f"])
    one = lambda b: F.call_function("shiftleft", F.lit(1).cast("long"), b)

    def mask(low: int, high: int) -> Column:
        return F.aggregate(f, F.lit(0).cast("long"), lambda m, x: F.when((_bin(x) >= low) & (_bin(x) < high), m.bitwiseOR(one(_bin(x) % 64))).otherwise(m))

    df = df.withColumn(t["lo"], mask(0, 64)).withColumn(t["hi"], mask(64, BINS))
    lo, hi = F.col(t["lo"]), F.col(t["hi"])

    def source(b: Column) -> Column:
        tries = [F.pmod(F.xxhash64(b, F.lit(j)), F.lit(BINS)).cast("int") for j in range(TRIES)]
        last = _bin(F.array_min(F.transform(f, lambda x: F.struct(F.xxhash64(b, _bin(x), F.lit(TRIES)).alias("h"), x.alias("x"))))["x"])
        out = F.when(_bit(lo, hi, b), b)
        for c in tries:
            out = out.when(_bit(lo, hi, c), c)
        return out.otherwise(last)

    df = df.withColumn(t["src"], F.when(F.size(f) > 0, F.transform(F.sequence(F.lit(0), F.lit(BINS - 1)), source)).otherwise(F.array().cast("array<int>")))
    # sorted as signed numbers, the upper half of the bins comes first
    count = lambda half, b: F.bit_count(half.bitwiseAND(F.bitwise_not(F.call_function("shiftleft", F.lit(-1).cast("long"), b))))
    rank = lambda b: F.when(b >= 64, count(hi, b - 64)).otherwise(F.bit_count(hi) + count(lo, b))
    df = df.withColumn(t["src"], F.transform(t["src"], lambda b: F.get(f, rank(b)).bitwiseAND(F.lit((1 << BITS) - 1))))
    v = F.col(t["src"])

    def packed(k: Column) -> Column:
        out = F.get(v, k * 8)
        for j in range(1, 8):
            out = out.bitwiseOR(F.call_function("shiftleft", F.get(v, k * 8 + j), F.lit(8 * j)))
        return out

    df = df.withColumn(name, F.when(F.size(v) > 0, F.transform(F.sequence(F.lit(0), F.lit(BINS // 8 - 1)), packed)).otherwise(F.array().cast("array<bigint>")))
    return df.drop(*t.values())


def likeness(a: Column, b: Column) -> Column:
    """Estimated Jaccard similarity of two fingerprints, in 0..1; two empty ones are alike, one is unlike all others."""

    def unequal(x: Column, y: Column) -> Column:
        z = x.bitwiseXOR(y)
        for n in (4, 2, 1):
            z = z.bitwiseOR(F.shiftrightunsigned(z, n))
        return F.bit_count(z.bitwiseAND(F.lit(0x0101010101010101)))

    differ = F.aggregate(F.zip_with(a, b, unequal), F.lit(0), lambda m, x: m + x)
    chance = 2.0**-BITS
    share = 1 - differ / F.lit(float(BINS))
    return F.when((F.size(a) == 0) & (F.size(b) == 0), F.lit(1.0)).when((F.size(a) == 0) | (F.size(b) == 0), F.lit(0.0)).otherwise(F.greatest(F.lit(0.0), (share - chance) / (1 - chance)))


def text_form(fp: Column) -> Column:
    """The packed fingerprint as hexadecimal digits; of an empty text: an empty string."""
    return F.array_join(F.transform(fp, lambda x: F.lpad(F.hex(x), 16, "0")), "")


def with_next(df: DataFrame, key: str, carried: list[str], tie: Column) -> DataFrame:
    """Adds next_<column> of the row that follows in descending order of ``key`` (long, no nulls).

    After the last row comes the first.  Keys are cut into ranges of about equal counts, ordered apart; the
    first row of each range also goes to the range before it, so all rows are shuffled once.
    """
    spark = df.sparkSession
    rows = df.agg(F.count("*")).first()[0]
    n = max(1, min(RANGES, max(int(spark.conf.get("spark.sql.shuffle.partitions")), rows // 20_000)))
    cuts = df.agg(F.percentile_approx(key, [i / n for i in range(1, n)], 10 * n)).first()[0] if n > 1 else []
    cuts = sorted({*(cuts or [])})
    depth = max(1, len(cuts).bit_length())
    bounds = F.lit(cuts + [2**63 - 1] * ((1 << depth) - len(cuts))).cast("array<bigint>")
    place = F.aggregate(F.lit([1 << d for d in range(depth - 1, -1, -1)]), F.lit(0), lambda lo, s: F.when(F.get(bounds, lo + s - 1) <= F.col(key), lo + s).otherwise(lo))
    df = df.withColumn("__range", place)
    heads = sorted((r[0], r[1]) for r in df.groupBy("__range").agg(F.max(key).alias("head")).collect())
    guests = [(head, heads[(i + 1) % len(heads)][0]) for i, (_, head) in enumerate(heads)]
    guests = spark.createDataFrame(guests, "__head long, __host int")
    df = df.join(F.broadcast(guests), F.col(key) == F.col("__head"), "left")
    own = F.struct(F.col("__range").alias("at"), F.lit(False).alias("guest"))
    guest = F.struct(F.col("__host").alias("at"), F.lit(True).alias("guest"))
    df = df.withColumn("__seat", F.explode(F.when(F.col("__host").isNull(), F.array(own)).otherwise(F.array(own, guest))))
    w = Window.partitionBy("__seat.at").orderBy("__seat.guest", F.desc(key), tie)
    df = df.select("*", *(F.lead(c).over(w).alias(f"next_{c}") for c in carried))
    return df.filter("NOT __seat.guest").drop("__range", "__head", "__host", "__seat")


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5) -> DataFrame:
    """doc_id long, text string, fingerprint array<long>: see with_fingerprint.

    Words are ``[^\\x20\\x09-\\x0D]+``, unchanged; fewer than ``width``: the whole sequence is one shingle.
    Null text counts as empty, an empty or blank text has an empty fingerprint.  Equal texts have equal
    fingerprints.  Null and repeated ids stay as they are; an empty table gives an empty result.
    """
    docs = pick(docs, doc_id=f"{id_col}:long", text=f"{text_col}:string")
    return with_fingerprint(docs.withColumn("text", F.coalesce("text", F.lit(""))), "text", "fingerprint", width)


def edited_fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", part: int = 3, width: int = 5) -> DataFrame:
    """Fingerprints of all texts and of edited ones: of n code points, the last n div ``part`` are replaced by
    as many (or all) from the start of the next text in descending doc_id, the first following the last.

    Returns doc_id, text, n_chars, edited_text, fingerprint, edited_fingerprint (arrays of longs),
    near_edited, near_next (double).  Rows of equal doc_id follow each other by a hash of their text; null
    doc_id comes last.  A lone document is its own next.
    """
    df = fingerprints(docs, id_col, text_col, width).withColumn("__key", F.coalesce("doc_id", F.lit(-(2**63))))
    df = with_next(df, "__key", ["text", "fingerprint"], F.xxhash64("text"))
    n = F.char_length("text")
    cut = F.floor(n / part).cast("int")
    df = df.withColumn("n_chars", n.cast("long")).withColumn("edited_text", F.concat(F.substring(F.col("text"), F.lit(1), n - cut), F.substring(F.col("next_text"), F.lit(1), cut)))
    df = with_fingerprint(df.drop("next_text"), "edited_text", "edited_fingerprint", width)
    return df.select("doc_id", "text", "n_chars", "edited_text", "fingerprint", "edited_fingerprint", likeness(F.col("fingerprint"), F.col("edited_fingerprint")).alias("near_edited"), likeness(F.col("fingerprint"), F.col("next_fingerprint")).alias("near_next"))
