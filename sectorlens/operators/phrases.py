"""Token frequencies and statistical phrases of a tokenised corpus.

A corpus is a table (org_id, tokens).
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sectorlens.operators.ranking import ranked
from sectorlens.session import cut

DELIMITER = "_"

# What is sent to all tasks at most; beyond it the tokens are joined.
SENT_BYTES = 1 << 28
SENT_PAIRS = 1 << 25

# Pairs that a task holds while it counts them, and rows that it hands over at a time.
HELD_PAIRS = 1_000_000
SENT_ROWS = 1 << 16
PART_TOKENS = 1 << 18  # tokens that a task looks up at a time


def document_frequency(corpus: DataFrame, tokens: str = "tokens") -> DataFrame:
    """(token, df): number of documents that hold the token."""
    return (
        corpus.select(F.explode(F.array_distinct(tokens)).alias("token"))
        .groupBy("token")
        .agg(F.count("*").alias("df"))
    )


def kept_tokens(
    corpus: DataFrame, no_below: int = 10, no_above: float = 0.9, keep_n: int | None = None
) -> DataFrame:
    """(token, df) of the tokens that pass the frequency limits.

    With ``keep_n`` only so many of the most frequent stay; equal frequencies go by token.
    """
    documents = corpus.agg(F.count("*").alias("n_docs"))  # a single row
    kept = (
        document_frequency(corpus)
        .join(F.broadcast(documents))
        .where((F.col("df") >= no_below) & (F.col("df") <= no_above * F.col("n_docs")))
        .select("token", "df")
    )
    if keep_n is None:
        return kept
    whole = kept.withColumn("_all", F.lit(0))
    order = [-F.col("df"), F.col("token")]
    return ranked(whole, ["_all"], order).where(F.col("rn") <= keep_n).select("token", "df")


def filter_frequency(
    corpus: DataFrame, no_below: int = 10, no_above: float = 0.9, keep_n: int | None = None
) -> DataFrame:
    """The corpus with only the kept tokens, in order; documents left without tokens stay."""
    kept = cut(kept_tokens(corpus, no_below, no_above, keep_n).select("token"))
    sent = _sent(kept)
    if sent is None:
        return _filtered_by_join(corpus, kept)
    once, others = by_repetition(corpus)

    def rows(batches):
        for batch in in_parts(batches):
            values, lengths = flat(batch.column("tokens"))
            stay = places(values, sent) >= 0
            yield _batch(batch, values.filter(pa.array(stay)), _per_row(stay, lengths), np.zeros(len(lengths), bool))

    filtered = once.mapInArrow(rows, once.schema)
    return filtered if others is None else filtered.unionByName(_filtered_by_join(others, kept))


def _filtered_by_join(corpus: DataFrame, kept: DataFrame) -> DataFrame:
    placed = corpus.select("org_id", F.posexplode("tokens").alias("pos", "token"))
    remaining = (
        placed.join(kept, "token", "left_semi")
        .groupBy("org_id")
        .agg(F.sort_array(F.collect_list(F.struct("pos", "token"))).alias("placed"))
        .select("org_id", F.col("placed.token").alias("tokens"))
    )
    return _with_all_documents(corpus, remaining)


def _sent(tokens: DataFrame) -> pa.Array | None:
    """The tokens for all tasks, or nothing where they are too long together."""
    if (tokens.agg(F.sum(F.octet_length("token") + 8)).first()[0] or 0) > SENT_BYTES:
        return None
    return tokens.toArrow().column("token").combine_chunks().cast(pa.string())


def by_repetition(corpus: DataFrame, key: str = "org_id", tokens: str = "tokens") -> tuple[DataFrame, DataFrame | None]:
    """The rows (key, tokens) whose key comes once, and the others, whose tokens go together by key."""
    corpus = corpus.select(key, tokens)
    several = cut(corpus.groupBy(key).count().where(F.expr("count > 1") | F.col(key).isNull()).select(F.col(key).alias("_id")))
    if several.isEmpty():
        return corpus, None
    same = F.col(key).eqNullSafe(F.col("_id"))
    return corpus.join(several, same, "left_anti"), corpus.join(several, same, "left_semi")


def in_parts(batches, tokens: str = "tokens"):
    """The batches cut into parts of about ``PART_TOKENS`` tokens."""
    for batch in batches:
        n = pc.sum(pc.list_value_length(batch.column(tokens))).as_py() or 0
        step = max(1, batch.num_rows * PART_TOKENS // max(n, PART_TOKENS))
        for low in range(0, batch.num_rows, step):
            yield batch.slice(low, step)


def flat(column: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """All tokens of a batch, and how many each row has."""
    return column.flatten(), pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64)


def _per_row(marked: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """How many places of each row are marked."""
    return np.diff(np.r_[0, np.cumsum(marked)][np.r_[0, np.cumsum(lengths)]])


def _batch(batch: pa.RecordBatch, values: pa.Array, lengths: np.ndarray, null: np.ndarray) -> pa.RecordBatch:
    ends = pa.array(np.r_[0, np.cumsum(lengths)].astype(np.int32), mask=np.r_[null, False])
    return pa.RecordBatch.from_arrays([batch.column("org_id"), pa.ListArray.from_arrays(ends, values)], ["org_id", "tokens"])


def _with_all_documents(corpus: DataFrame, remaining: DataFrame) -> DataFrame:
    return corpus.select("org_id").join(remaining, "org_id", "left").withColumn(
        "tokens", F.coalesce("tokens", F.array().cast("array<string>"))
    )


def _pairs(corpus: DataFrame) -> DataFrame:
    """(org_id, pos, first, second): adjacent tokens, read from the array without a shuffle."""
    pair = F.expr(
        "transform(sequence(1, size(tokens) - 1), "
        "i -> struct(i - 1 as pos, tokens[i - 1] as first, tokens[i] as second))"
    )
    return (
        corpus.where(F.size("tokens") > 1)
        .select("org_id", F.explode(pair).alias("p"))
        .select("org_id", "p.*")
    )


def unigram_counts(corpus: DataFrame) -> DataFrame:
    return corpus.select(F.explode("tokens").alias("token")).groupBy("token").agg(F.count("*").alias("n"))


def bigram_counts(corpus: DataFrame) -> DataFrame:
    return _pairs(corpus).groupBy("first", "second").agg(F.count("*").alias("n"))


def total_tokens(corpus: DataFrame) -> DataFrame:
    return corpus.agg(F.coalesce(F.sum(F.size("tokens")), F.lit(0)).alias("total"))


def accepted_phrases(corpus: DataFrame, threshold: float = 0.25, min_count: int = 2) -> DataFrame:
    """(first, second, n, npmi) of the adjacent pairs whose NPMI exceeds the threshold.

    Pairs of the most frequent tokens, as many as can be sent to all tasks, are counted and shuffled
    as numbers; pairs with another token, if there are more, as they are.
    """
    unigrams = cut(unigram_counts(corpus).where(F.col("token").isNotNull() & (F.col("n") >= min_count)))
    total = cut(total_tokens(corpus))
    least = _least_sent(unigrams)
    table = unigrams.where(F.col("n") >= least).toArrow()
    sent, n_sent = table.column("token").combine_chunks().cast(pa.string()), table.column("n").to_numpy()
    joined = _coded_pairs(corpus, sent, n_sent, total.first()[0], threshold, min_count)
    if unigrams.where(F.col("n") < least).count():
        counted = _other_pairs(corpus, sent).groupBy("first", "second").agg(F.count("*").alias("n")).where(F.col("n") >= min_count)
        others = (
            counted.join(unigrams.select(F.col("token").alias("first"), F.col("n").alias("n_first")), "first")
            .join(unigrams.select(F.col("token").alias("second"), F.col("n").alias("n_second")), "second")
        )
        joined = joined.unionByName(others)
    joined = joined.join(F.broadcast(total))
    both = F.col("n") / F.col("total")
    apart = F.col("n_first") / F.col("total") * (F.col("n_second") / F.col("total"))
    npmi = F.try_divide(F.log(both / apart), -F.log(both))
    return joined.select("first", "second", "n", F.round(npmi, 9).alias("npmi")).where(F.col("npmi") > threshold)


def _least_sent(unigrams: DataFrame) -> int:
    """Tokens from this number of occurrences on are short enough together to be sent to all tasks."""
    sizes = unigrams.groupBy("n").agg(F.sum(F.octet_length("token") + 16).alias("size")).toPandas().sort_values("n", ascending=False)
    fitting = sizes[sizes["size"].cumsum() <= SENT_BYTES]
    return int(fitting["n"].min()) if len(fitting) else 1 << 62


def _adjacent(values: pa.Array, lengths: np.ndarray, known: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The places of all tokens among the known ones (else -1), and of each token whether a next one of its row follows."""
    at = places(values, known)
    follows = np.ones(len(at), bool)
    follows[np.cumsum(lengths)[lengths > 0] - 1] = False
    return at, np.flatnonzero(follows)


def _coded_pairs(corpus: DataFrame, known: pa.Array, n_known: np.ndarray, total: int, threshold: float, min_count: int) -> DataFrame:
    """(first, second, n, n_first, n_second) of the adjacent pairs of known tokens, from ``min_count`` on.

    Pairs travel as numbers, summed up in their task. A pair comes as often as its rarer token at most;
    where even that is too few for the threshold, it is left away.
    """

    def hopeful(codes: np.ndarray) -> np.ndarray:
        if threshold < 0:
            return np.ones(len(codes), bool)
        firsts, seconds = n_known[codes // len(known)], n_known[codes % len(known)]
        most = np.minimum(firsts, seconds) / total
        with np.errstate(divide="ignore", invalid="ignore"):
            return ~(np.log(most / (firsts / total * (seconds / total))) / -np.log(most) < threshold - 1e-6)

    def summed(parts: list) -> tuple[np.ndarray, np.ndarray]:
        codes, place = np.unique(np.concatenate([c for c, _ in parts]), return_inverse=True)
        return codes, np.bincount(place, np.concatenate([n for _, n in parts]), len(codes)).astype(np.int64)

    def counted(batches):
        held = []
        for batch in in_parts(batches):
            values, lengths = flat(batch.column("tokens"))
            at, begins = _adjacent(values, lengths, known)
            begins = begins[(at[begins] >= 0) & (at[begins + 1] >= 0)]
            codes, n = np.unique(at[begins] * len(known) + at[begins + 1], return_counts=True)
            stay = hopeful(codes)
            held.append((codes[stay], n[stay]))
            if sum(len(c) for c, _ in held) > HELD_PAIRS:
                held = [summed(held)]
                if len(held[0][0]) > HELD_PAIRS // 2:
                    yield from numbers(*held.pop())
        if held:
            yield from numbers(*summed(held))

    def numbers(codes: np.ndarray, n: np.ndarray):
        for low in range(0, len(codes), SENT_ROWS):
            yield pa.RecordBatch.from_arrays([pa.array(x[low : low + SENT_ROWS].astype(np.int64)) for x in (codes, n)], ["code", "n"])

    def named(batches):
        for batch in batches:
            places = np.divmod(batch.column("code").to_numpy(), len(known)) if len(known) else (np.zeros(0, np.int64),) * 2
            words, counts = [known.take(pa.array(x)) for x in places], [pa.array(n_known[x]) for x in places]
            yield pa.RecordBatch.from_arrays([*words, batch.column("n"), *counts], ["first", "second", "n", "n_first", "n_second"])

    sums = corpus.select("tokens").mapInArrow(counted, "code long, n long").groupBy("code").agg(F.sum("n").alias("n"))
    frequent = sums.where(F.col("n") >= min_count)
    return frequent.mapInArrow(named, "first string, second string, n long, n_first long, n_second long")


def _other_pairs(corpus: DataFrame, known: pa.Array) -> DataFrame:
    """(first, second): the adjacent pairs with a token that isn't known."""

    def rows(batches):
        for batch in in_parts(batches):
            values, lengths = flat(batch.column("tokens"))
            at, begins = _adjacent(values, lengths, known)
            begins = begins[(at[begins] < 0) | (at[begins + 1] < 0)]
            yield pa.RecordBatch.from_arrays([values.take(pa.array(begins)), values.take(pa.array(begins + 1))], ["first", "second"])

    return corpus.select("tokens").mapInArrow(rows, "first string, second string")


def detect_phrases(corpus: DataFrame, threshold: float = 0.25, min_count: int = 2) -> DataFrame:
    """Join accepted adjacent tokens with ``_``, left to right, each token used once.

    A run of pairs accepted at following positions is an island; taking every second pair of
    an island, from its start, is what a scan from left to right would join.
    """
    accepted = cut(accepted_phrases(corpus, threshold, min_count).select("first", "second"))
    known = None if accepted.count() > SENT_PAIRS else _sent(accepted.select(F.explode(F.array("first", "second")).alias("token")).distinct())
    if known is None:
        return _joined_by_join(corpus, accepted)
    pairs = _codes(accepted, known)
    once, others = by_repetition(corpus)

    def rows(batches):
        for batch in in_parts(batches):
            column = batch.column("tokens")
            values, lengths = flat(column)
            starts = _starts(values, lengths, known, pairs)
            at = np.flatnonzero(starts)
            joined = pc.binary_join_element_wise(values.take(pa.array(at)), values.take(pa.array(at + 1)), DELIMITER)
            place = np.arange(len(values))
            place[at] = len(values) + np.arange(len(at))
            stay = np.ones(len(values), bool)
            stay[at + 1] = False
            tokens = pa.concat_arrays([values, joined]).take(pa.array(place[stay]))
            yield _batch(batch, tokens, _per_row(stay, lengths), column.is_null().to_numpy(zero_copy_only=False))

    found = once.mapInArrow(rows, once.schema)
    return found if others is None else found.unionByName(_joined_by_join(others, accepted))


def _codes(accepted: DataFrame, known: pa.Array) -> np.ndarray:
    """The pairs as numbers, by the places of their tokens, in order."""

    def rows(batches):
        for batch in batches:
            first, second = (places(batch.column(c), known) for c in ("first", "second"))
            yield pa.RecordBatch.from_arrays([pa.array(first * len(known) + second)], ["code"])

    return np.sort(accepted.mapInArrow(rows, "code long").toArrow().column("code").to_numpy())


def places(values: pa.Array, known: pa.Array) -> np.ndarray:
    """The place of every value among the known ones, -1 for others; of two lists the shorter is hashed."""
    if len(known) <= len(values):
        found = pc.fill_null(pc.index_in(values, value_set=known, skip_nulls=True), -1)
        return found.to_numpy(zero_copy_only=False).astype(np.int64)
    kinds = values.dictionary_encode()
    at = pc.index_in(known, value_set=kinds.dictionary, skip_nulls=True)
    hit = np.flatnonzero(at.is_valid().to_numpy(zero_copy_only=False))
    place = np.full(len(kinds.dictionary) + 1, -1, np.int64)  # the last one is for nulls
    place[at.take(pa.array(hit)).to_numpy()] = hit
    return place[pc.fill_null(kinds.indices, len(kinds.dictionary)).to_numpy(zero_copy_only=False)]


def _starts(values: pa.Array, lengths: np.ndarray, known: pa.Array, pairs: np.ndarray) -> np.ndarray:
    """Marks the tokens that are joined to the next one: every second one of a run of accepted pairs."""
    at = places(values, known)
    accepted = np.zeros(len(at), bool)
    if len(at) > 1 and len(pairs):
        code = at[:-1] * len(known) + at[1:]
        accepted[:-1] = (at[:-1] >= 0) & (at[1:] >= 0) & (pairs[np.minimum(np.searchsorted(pairs, code), len(pairs) - 1)] == code)
    accepted[np.cumsum(lengths)[lengths > 0] - 1] = False  # the last token of a row
    place = np.arange(len(at))
    begins = accepted & ~np.r_[False, accepted[:-1]]
    return accepted & ((place - np.maximum.accumulate(np.where(begins, place, 0))) % 2 == 0)


def _joined_by_join(corpus: DataFrame, accepted: DataFrame) -> DataFrame:
    found = _pairs(corpus).join(accepted, ["first", "second"], "left_semi").select("org_id", "pos")
    island = F.col("pos") - F.row_number().over(W.partitionBy("org_id").orderBy("pos"))
    joined = (
        found.withColumn("island", island)
        .groupBy("org_id", "island")
        .agg(F.min("pos").alias("first"), F.max("pos").alias("last"))
        .groupBy("org_id")
        .agg(F.sort_array(F.flatten(F.collect_list(F.sequence("first", "last", F.lit(2))))).alias("starts"))
    )
    # Tokens between two joins are copied as slices, so a document costs one pass.
    pieces = F.expr(
        "flatten(transform(sequence(0, size(starts)), i -> concat("
        "  slice(tokens, if(i = 0, 0, starts[i - 1] + 2) + 1,"
        "        if(i = size(starts), size(tokens), starts[i]) - if(i = 0, 0, starts[i - 1] + 2)),"
        f"  if(i = size(starts), cast(array() as array<string>),"
        f"     array(concat(tokens[starts[i]], '{DELIMITER}', tokens[starts[i] + 1])))"
        ")))"
    )
    return corpus.join(joined, "org_id", "left").select(
        "org_id", F.when(F.col("starts").isNull(), F.col("tokens")).otherwise(pieces).alias("tokens")
    )


def ngrams(corpus: DataFrame, n: int = 2, threshold: float = 0.25, min_count: int = 2) -> DataFrame:
    """Repeat phrase detection for 2..n, counting anew on the joined tokens each time."""
    for _ in range(2, n + 1):
        corpus = cut(detect_phrases(corpus, threshold, min_count))
    return corpus
