"""I-Match fingerprints with randomised lexicons, in DataFrame functions only.

Terms are lower-cased runs of letters and digits, hashed into `BUCKETS` buckets, so the lexicon has a
fixed size: four bits per bucket say how far its inverse document frequency over all documents lies
from the chosen band. A document keeps its distinct terms of the band, and where these are fewer than
`FEW` the terms nearest to the band up to that number, so one term more or less changes one term. It
sorts them and hashes those that fall into each of several random lexicon subsets: the whole
lexicon, and for each rate 1/R `LEXICONS` disjoint subsets that hold one term in R. A subset without a
term gives a blank. Equal texts have equal fingerprints.

The likeness of two fingerprints is the share of equal hashes among the subsets that either text
has terms in, at the sparsest rate where those are `ENOUGH` (dense subsets rarely agree
on long texts, sparse ones are blank on short texts); equal fingerprints have likeness 1.

A null text counts as empty: all blanks, which equals the fingerprint of any text without a term.
Rows of one doc_id and different texts follow each other by a hash of the text; equal rows are one
document in the order and each get a row; a null doc_id comes last. A single document is its own
next one. Columns other than doc_id and text aren't read.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sectorlens.session import cut

BUCKETS = 1 << 18
COMMONEST, RAREST = 0.05, 0.0002  # shares of documents between which a term is kept
IDF_BAND = (math.log(1 / COMMONEST), math.log(1 / RAREST))
FEW = 8
STEP, FARTHEST = 0.25, 15
RATES = (16, 64, 256, 1024)
ENOUGH = 5  # subsets with terms that a rate needs for its share to count
LEXICONS = 16
NO_ID = -(1 << 63)


def terms_of(text: str | Column) -> Column:
    """The distinct hashed terms of a text."""
    words = F.array_remove(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), "")
    return F.array_distinct(F.transform(words, lambda w: F.pmod(F.xxhash64(w), F.lit(BUCKETS))))


class Lexicon(list):
    """The buckets inside the band, a bit each in `BUCKETS` / 64 numbers.

    ``packed`` has every bucket's distance from the band in steps, 0 inside it, four bits each in
    `BUCKETS` / 16 numbers.
    """

    def __init__(self, packed: list[int]):
        super().__init__([0] * (BUCKETS // 64))
        self.packed = packed
        for word, bits in enumerate(packed):
            for place in range(16 if bits else 0):
                if bits >> place * 4 & FARTHEST == FARTHEST:
                    self[word >> 2] |= 1 << (word & 3) * 16 + place


def lexicon_of(texts: DataFrame, text_col: str = "text", band: tuple[float, float] = IDF_BAND) -> Lexicon:
    """The buckets inside the band and the distance of all others.

    The driver gets no more than these numbers; a bucket that no text has is farthest.
    """
    seen = texts.select(F.explode(terms_of(F.col(text_col))).alias("term")).groupBy("term").count()
    total = max(texts.count(), 1)
    idf = F.log(F.lit(float(total)) / F.col("count"))
    away = F.greatest(F.lit(band[0]) - idf, idf - F.lit(band[1]), F.lit(0.0))
    steps = F.least(F.ceil(away / STEP), F.lit(FARTHEST - 1))
    # The farthest step is all bits set, so the numbers hold what is missing to it.
    nearer = seen.select("term", (FARTHEST - steps).cast("long").alias("nearer"))
    words = nearer.groupBy(F.shiftright("term", 4).alias("word")).agg(
        F.bit_or(F.expr("shiftleft(nearer, cast((term & 15) * 4 as int))")).alias("bits")
    )
    packed = [0] * (BUCKETS // 16)
    for row in words.collect():
        packed[row["word"]] = row["bits"]
    return Lexicon(packed)


def _nearest(terms: str, lexicon: Lexicon) -> Column:
    """The terms by their distance from the band, each under its distance."""
    packed = F.lit(lexicon.packed).cast("array<bigint>")

    def placed(t: Column) -> Column:
        word = F.get(packed, F.shiftright(t, 4).cast("int"))
        nearer = F.call_function("shiftright", word, (t.bitwiseAND(F.lit(15)) * 4).cast("int")).bitwiseAND(F.lit(FARTHEST))
        return F.shiftleft(F.lit(FARTHEST) - nearer, 20).bitwiseOR(t)

    # Sorted without a comparator of its own, which would be called for every pair of terms.
    return F.sort_array(F.transform(terms, placed))


def _kept(nearest: str) -> Column:
    """The terms in the band, or the `FEW` nearest to it, sorted."""
    inside = F.size(F.filter(nearest, lambda c: c < 1 << 20))
    chosen = F.slice(nearest, 1, F.greatest(inside, F.lit(FEW)))
    return F.sort_array(F.transform(chosen, lambda c: c.bitwiseAND(F.lit((1 << 20) - 1))))


def _drawn(terms: str, rate: int) -> Column:
    """The terms in one of the lexicons of a rate, under the number of the lexicon."""
    draw = F.transform(terms, lambda t: F.shiftleft(F.pmod(F.xxhash64(t, F.lit(rate)), F.lit(rate)), 20).bitwiseOR(t))
    return F.filter(draw, lambda c: c < LEXICONS << 20)


def _subset(drawn: str, lexicon: int) -> Column:
    return F.filter(drawn, lambda c: F.shiftright(c, 20) == lexicon)


def with_fingerprint(df: DataFrame, text_col: str, out: str, lexicon: Lexicon) -> DataFrame:
    """Add `out`: an array with the hash of each lexicon subset, null where it holds no term."""
    terms, near, band = (f"_{out}_{name}" for name in ("terms", "near", "band"))
    df = df.withColumn(terms, terms_of(F.col(text_col)))
    df = df.withColumn(near, _nearest(terms, lexicon))
    df = df.withColumn(band, _kept(near))
    parts = [f"_{out}_{rate}" for rate in RATES]
    df = df.withColumns({part: _drawn(band, rate) for part, rate in zip(parts, RATES, strict=True)})

    def hashed(terms_: Column) -> Column:
        return F.when(F.size(terms_) > 0, F.xxhash64(terms_).bitwiseAND(F.lit(0xFFFFFF)))

    subsets = [F.col(band)] + [_subset(part, k) for part in parts for k in range(LEXICONS)]
    return df.withColumn(out, F.array(*[hashed(s) for s in subsets])).drop(terms, near, band, *parts)


def written(fingerprint: str) -> Column:
    """A fingerprint as a string: six hex digits per subset, or six hyphens."""
    return F.array_join(
        F.transform(fingerprint, lambda h: F.coalesce(F.lower(F.lpad(F.hex(h), 6, "0")), F.lit("-" * 6))), ""
    )


def likeness(left: str, right: str) -> Column:
    """Between 0 and 1; see the module's text."""
    out = None
    for i in range(len(RATES)):  # dense to sparse; a sparser rate with enough terms wins
        start = 2 + i * LEXICONS
        pairs = F.arrays_zip(
            F.slice(left, start, LEXICONS).alias("x"), F.slice(right, start, LEXICONS).alias("y")
        )
        either = F.size(F.filter(pairs, lambda p: p["x"].isNotNull() | p["y"].isNotNull()))
        equal = F.size(F.filter(pairs, lambda p: p["x"] == p["y"]))
        share = F.coalesce(F.try_divide(equal.cast("double"), either), F.lit(0.0))
        out = share if out is None else F.when(either >= ENOUGH, share).otherwise(out)
    return F.when(F.col(left) == F.col(right), F.lit(1.0)).otherwise(out)


def next_documents(texts: DataFrame) -> DataFrame:
    """``(key, h, n, next_key, next_h)``: the next document of each, descending key, after the last the first.

    Keys are range-partitioned and written; a partition's last document looks up the first of the
    partition after it, so only one row per partition meets in one task.
    """
    spark = texts.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    order = [F.desc("key"), F.asc("h")]
    keys = texts.groupBy("key", "h").agg(F.max(F.length("text")).cast("long").alias("n"))
    placed = cut(keys.repartitionByRange(parts, *order).withColumn("part", F.spark_partition_id()))
    window = W.partitionBy("part").orderBy(*order)
    led = placed.withColumn("next", F.lead(F.struct("key", "h")).over(window)).withColumn("row", F.row_number().over(window))
    heads = led.where("row = 1").select("part", F.struct("key", "h").alias("head"))
    everywhere = W.partitionBy().orderBy("part")  # a row per partition
    heads = heads.select(
        "part",
        F.coalesce(
            F.lead("head").over(everywhere),
            F.first("head").over(everywhere.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)),
        ).alias("after"),
    )
    joined = led.join(heads, "part").withColumn("next", F.coalesce("next", "after"))
    return joined.select("key", "h", "n", F.col("next.key").alias("next_key"), F.col("next.h").alias("next_h"))


def fingerprints(docs: DataFrame, band: tuple[float, float] = IDF_BAND) -> DataFrame:
    """Fingerprints of each text and of its edited form, and their likeness; see the module's text.

    The edited text has its last ``floor(n / 2)`` code points replaced by the first as many of the
    next document.
    """
    texts = docs.select(
        F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("key"), F.coalesce("text", F.lit("")).alias("text")
    ).withColumn("h", F.xxhash64("text"))
    lexicon = lexicon_of(texts, band=band)
    pairs = cut(next_documents(texts).withColumn("k", F.floor(F.col("n") / 2).cast("int")))
    heads = (
        pairs.select(F.col("key").alias("of"), F.col("h").alias("of_h"), "k", F.col("next_key").alias("key"), F.col("next_h").alias("h"))
        .join(texts, ["key", "h"])
        .select("of", "of_h", F.left("text", F.col("k")).alias("head"))
        .groupBy("of", "of_h").agg(F.any_value("head").alias("head"))
        .select(F.col("of").alias("key"), F.col("of_h").alias("h"), "head")
    )
    edited = texts.join(pairs, ["key", "h"]).join(heads, ["key", "h"]).withColumn(
        "edited", F.concat(F.left("text", (F.col("n") - F.col("k")).cast("int")), "head")
    )
    marked = with_fingerprint(with_fingerprint(edited, "text", "own", lexicon), "edited", "other", lexicon)
    made = cut(
        marked.select("key", "h", "n", "next_key", "next_h", F.sha2(F.encode("edited", "UTF-8"), 256).alias("edited_sha256"), "own", "other")
    )
    after = made.select(F.col("key").alias("next_key"), F.col("h").alias("next_h"), F.col("own").alias("next_own"))
    after = after.dropDuplicates(["next_key", "next_h"])
    return made.join(after, ["next_key", "next_h"]).select(
        F.when(F.col("key") != NO_ID, F.col("key")).alias("doc_id"),
        F.col("n").alias("n_chars"),
        "edited_sha256",
        written("own").alias("fingerprint"),
        written("other").alias("edited_fingerprint"),
        likeness("own", "other").alias("near_edited"),
        likeness("own", "next_own").alias("near_next"),
    )
