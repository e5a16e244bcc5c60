"""Ranked lexical search: the best documents of each item by a saturated term weight.

A document is a vector of integer impacts, one per term of the items. As in LEMP (Teflioudi, Gemulla
and Mykytiuk 2015) the vectors are ordered by length and cut into buckets. A bucket is left out for
an item where the product of the two lengths, its bound by Cauchy and Schwarz, is below the score
that the item's list needs. Inside a bucket the item's weightiest coordinates are added up and the
rest is bounded by the lengths of what is left; only documents whose bound reaches the needed score
are scored, exactly in integers.

The longest vectors go first, as a job of their own: the scores they reach are known to all tasks
of the second job. A task hands on the best of each item, which are merged by a trimmed window, so
no list grows with the documents. Items are searched in blocks of about ``BLOCK_TERMS`` terms, which
travel with the tasks; a block reads the documents once.

A null or empty text has no terms: such a document is never found and such an item finds nothing.
Repeated documents rank each, repeated items get a list each. Equal scores go by doc_id, a null
doc_id last. Columns other than the ids and texts aren't read.
"""

from __future__ import annotations

import heapq
import math
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sectorlens.llm.arrow import text_slices
from sectorlens.llm.words import word_hashes
from sectorlens.session import cut

BEST = 20
BLOCK_TERMS = 1 << 18
BUCKET = 512
FOCUS = 6
LEADERS = 4096
NEVER = np.iinfo(np.int64).max
TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"  # the same terms as a pattern

_BETWEEN = np.zeros(256, bool)  # terms are runs of ASCII letters, digits and all characters above U+007F
_BETWEEN[0x00:0x30] = _BETWEEN[0x3A:0x41] = _BETWEEN[0x5B:0x61] = _BETWEEN[0x7B:0x80] = True


def item_terms(items: DataFrame) -> DataFrame:
    """``(item, item_id, term, times)``: the distinct terms of each row, numbered by ``item``."""

    def rows(batches):
        for part, data, bounds in text_slices(batches):
            hashes, first = word_hashes(data, bounds, _BETWEEN)
            owner = np.repeat(np.arange(len(bounds) - 1), np.diff(first))
            order = np.lexsort((hashes, owner))
            hashes, owner = hashes[order], owner[order]
            new = np.flatnonzero(np.r_[True, (hashes[1:] != hashes[:-1]) | (owner[1:] != owner[:-1])][: len(hashes)])
            times = np.diff(np.r_[new, len(hashes)])
            at = pa.array(owner[new])
            yield pa.RecordBatch.from_arrays(
                [part.column("item").take(at), part.column("item_id").take(at), pa.array(hashes[new].view(np.int64)), pa.array(times)],
                ["item", "item_id", "term", "times"],
            )

    chosen = items.select(F.monotonically_increasing_id().alias("item"), F.col("item_id").cast("long"), F.col("text").cast("string"))
    return chosen.mapInArrow(rows, "item long, item_id long, term long, times long")


def term_counts(documents: DataFrame, vocabulary: np.ndarray) -> DataFrame:
    """``(row, doc_id, n, terms, counts)``: all terms of a document counted, and those of the vocabulary listed.

    ``vocabulary`` holds sorted term hashes; a listed term is its place there.
    """

    def rows(batches):
        for part, data, bounds in text_slices(batches):
            hashes, first = word_hashes(data, bounds, _BETWEEN)
            owner = np.repeat(np.arange(len(bounds) - 1), np.diff(first))
            at = np.searchsorted(vocabulary, hashes)
            hit = at < len(vocabulary)
            hit[hit] = vocabulary[at[hit]] == hashes[hit]
            keys, counts = np.unique(owner[hit] * len(vocabulary) + at[hit], return_counts=True)
            owner, terms = np.divmod(keys, max(1, len(vocabulary)))
            ends = pa.array(np.searchsorted(owner, np.arange(len(bounds))), pa.int32())
            lists = [pa.ListArray.from_arrays(ends, pa.array(x.astype(np.int32))) for x in (terms, counts)]
            yield pa.RecordBatch.from_arrays(
                [part.column("row"), part.column("doc_id"), pa.array(np.diff(first)), *lists], ["row", "doc_id", "n", "terms", "counts"]
            )

    chosen = documents.select(
        F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long"), F.col("text").cast("string")
    )
    return chosen.mapInArrow(rows, "row long, doc_id long, n long, terms array<int>, counts array<int>")


def document_numbers(counted: DataFrame, size: int) -> np.ndarray:
    """The number of documents of each of the ``size`` vocabulary terms."""

    def rows(batches):
        total = np.zeros(size, np.int64)
        for batch in batches:
            total += np.bincount(batch.column("terms").flatten().to_numpy(), minlength=size)
        seen = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(seen), pa.array(total[seen])], ["term", "df"])

    found = counted.select("terms").mapInArrow(rows, "term long, df long").groupBy("term").agg(F.sum("df").alias("df"))
    out = np.zeros(size, np.int64)
    for row in found.collect():  # at most a block's terms
        out[row["term"]] = row["df"]
    return out


def impacts(counts: np.ndarray, weights: np.ndarray, m: np.ndarray) -> np.ndarray:
    """The integer impact of each term: its weight times its saturated count."""
    return weights * ((1_000_000_000 * counts) // (1000 * counts + 12 * m))


def impact_vectors(counted: DataFrame, weights: np.ndarray, documents: int, terms: int) -> DataFrame:
    """``(row, doc_id, length, terms, impacts)`` of the documents that share a weighted term with the items."""

    def rows(batches):
        for batch in batches:
            lists = batch.column("terms")
            place = lists.flatten().to_numpy()
            sizes = np.diff(lists.offsets.to_numpy())
            m = 75 + (25 * batch.column("n").to_numpy() * documents) // terms
            value = impacts(batch.column("counts").flatten().to_numpy().astype(np.int64), weights[place], np.repeat(m, sizes))
            ends = np.r_[0, np.cumsum(sizes)]
            owner = np.repeat(np.arange(batch.num_rows), sizes)
            length = np.sqrt(np.bincount(owner, value.astype(float) ** 2, minlength=batch.num_rows))
            out = pa.RecordBatch.from_arrays(
                [
                    batch.column("row"), batch.column("doc_id"), pa.array(length),
                    pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(place)),
                    pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(value)),
                ],
                ["row", "doc_id", "length", "terms", "impacts"],
            )
            yield out.filter(pa.array(length > 0))

    return counted.where("n > 0").mapInArrow(rows, "row long, doc_id long, length double, terms array<int>, impacts array<long>")


class Bucket:
    """Documents of similar length, their impacts by term, and the search of one item among them."""

    def __init__(self, rows: pa.Table, size: int):
        self.ids = rows.column("doc_id").to_numpy()
        self.known = ~np.asarray(rows.column("doc_id").is_null())
        self.squares = rows.column("length").to_numpy() ** 2
        self.longest = math.sqrt(self.squares.max())
        lists = rows.column("terms").combine_chunks()
        place = lists.flatten().to_numpy()
        order = np.argsort(place, kind="stable")
        self.owner = np.repeat(np.arange(len(self.squares)), np.diff(lists.offsets.to_numpy()))[order]
        self.value = rows.column("impacts").combine_chunks().flatten().to_numpy()[order]
        self.first = np.searchsorted(place[order], np.arange(size + 1))

    def postings(self, term: int) -> tuple[np.ndarray, np.ndarray]:
        span = slice(self.first[term], self.first[term + 1])
        return self.owner[span], self.value[span]

    def search(self, terms: np.ndarray, times: np.ndarray, length: float, needed: int) -> tuple[np.ndarray, np.ndarray]:
        """Places and scores of the documents that reach the needed score; ``terms`` go by weight.

        Bounds are in doubles, a little enlarged, so rounding never leaves a document out.
        """
        if length * self.longest * (1 + 1e-9) < needed:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        score = np.zeros(len(self.ids), np.int64)
        left = self.squares.copy()
        for term, count in zip(terms[:FOCUS], times[:FOCUS]):
            owner, value = self.postings(term)
            score[owner] += count * value
            left[owner] -= value.astype(float) ** 2
        rest = math.sqrt(float(np.sum(times[FOCUS:].astype(float) ** 2)))
        near = np.flatnonzero((score + rest * np.sqrt(np.maximum(left, 0) + 1e-9 * self.squares)) * (1 + 1e-9) >= needed)
        if len(near) == 0:
            return near, near
        for term, count in zip(terms[FOCUS:], times[FOCUS:]):
            owner, value = self.postings(term)
            score[owner] += count * value
        near = near[score[near] >= needed]
        return near, score[near]


def search_vectors(vectors: DataFrame, items: list, needed: np.ndarray, size: int, best: int) -> DataFrame:
    """``(item, doc_id, score)``: what each task finds, at most ``best`` rows an item and task.

    ``items`` holds (terms by falling weight, times, length) of each item, ``needed`` the least score of its list.
    """
    schema = "item int, doc_id long, score long"

    def rows(batches):
        lists: list[list] = [[] for _ in items]  # heaps of (score, -doc_id), the worst first
        least = needed.copy()

        def fill(bucket: Bucket):
            for i, (terms, times, length) in enumerate(items):
                at, scores = bucket.search(terms, times, length, int(least[i]))
                for place, score in zip(at.tolist(), scores.tolist()):
                    entry = (score, -int(bucket.ids[place]) if bucket.known[place] else -NEVER)
                    if len(lists[i]) < best:
                        heapq.heappush(lists[i], entry)
                    elif entry > lists[i][0]:
                        heapq.heapreplace(lists[i], entry)
                if len(lists[i]) == best:
                    least[i] = max(least[i], lists[i][0][0])

        for batch in batches:
            for low in range(0, batch.num_rows, BUCKET):
                fill(Bucket(pa.Table.from_batches([batch.slice(low, BUCKET)]), size))
        out = [(i, None if d == -NEVER else -d, s) for i, found in enumerate(lists) for s, d in found]
        columns = list(zip(*out)) or [(), (), ()]
        yield pa.RecordBatch.from_arrays(
            [pa.array(columns[0], pa.int32()), pa.array(columns[1], pa.int64()), pa.array(columns[2], pa.int64())], ["item", "doc_id", "score"]
        )

    return vectors.mapInArrow(rows, schema)


def _ranks(found: DataFrame, best: int) -> DataFrame:
    """The best rows of each item with their rank; rows beyond are trimmed before the shuffle."""
    order = W.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= best)


def _leading_length(vectors: DataFrame, leaders: int) -> float:
    """A length that at least ``leaders`` vectors have, from counts by eighths of powers of two."""
    bins = vectors.groupBy(F.floor(F.log2("length") * 8).alias("bin")).count().orderBy(F.desc("bin")).collect()  # at most 512 bins
    total = 0
    for row in bins:
        total += row["count"]
        if total >= leaders:
            return 2.0 ** (row["bin"] / 8)
    return 0.0


def _search_block(documents: DataFrame, block: pa.Table, best: int) -> DataFrame:
    """``(item_id, rank, doc_id, score)`` of the items of a block."""
    spark = documents.sparkSession
    vocabulary, place = np.unique(block.column("term").to_numpy().view(np.uint64), return_inverse=True)
    number = block.column("item").to_numpy()
    first = np.unique(number, return_index=True)[1]
    names = block.column("item_id").take(pa.array(first)).to_pylist()
    times = block.column("times").to_numpy()

    counted = cut(term_counts(documents, vocabulary))
    n_documents, n_terms = counted.where("n > 0").agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    if n_documents == 0:
        return spark.createDataFrame([], "item_id long, rank int, doc_id long, score long")
    df = document_numbers(counted, len(vocabulary))
    weights = np.array([math.floor(1000 * math.log((2 * n_documents + 2) / (2 * d + 1))) for d in df.tolist()], np.int64)

    items = []
    for own in map(slice, first, [*first[1:], len(number)]):
        terms, counts = place[own], times[own]
        order = np.argsort(-(weights[terms] * counts), kind="stable")
        items.append((terms[order], counts[order], math.sqrt(float(np.sum(counts.astype(float) ** 2)))))

    vectors = cut(impact_vectors(counted, weights, n_documents, n_terms))
    leading = _leading_length(vectors, LEADERS)
    needed = np.ones(len(items), np.int64)
    ordered = [F.desc("length"), F.col("row")]

    def searched(part: DataFrame) -> DataFrame:
        by_length = part.repartitionByRange(*ordered).sortWithinPartitions(*ordered)
        return search_vectors(by_length.select("doc_id", "length", "terms", "impacts"), items, needed, len(vocabulary), best)

    leaders = cut(_ranks(searched(vectors.where(F.col("length") >= leading)), best).drop("rank"))
    for row in leaders.groupBy("item").agg(F.count("*").alias("n"), F.min("score").alias("least")).collect():  # a row an item
        if row["n"] == best:
            needed[row["item"]] = row["least"]
    rest = searched(vectors.where(F.col("length") < leading))
    named = spark.createDataFrame(list(enumerate(names)), "item int, item_id long")  # the items of the block
    ranks = _ranks(leaders.unionByName(rest), best)
    return ranks.join(F.broadcast(named), "item").select("item_id", "rank", "doc_id", "score")


def search(documents: DataFrame, items: DataFrame, best: int = BEST, block_terms: int = BLOCK_TERMS) -> DataFrame:
    """``(item_id, rank, doc_id, score)``: the ``best`` documents of each item; see the module's text."""
    terms = cut(item_terms(items))
    total = terms.count()
    blocks = max(1, math.ceil(total / block_terms))
    found = []
    for i in range(blocks):
        block = terms.where(F.pmod(F.xxhash64("item"), F.lit(blocks)) == i).orderBy("item", "term").toArrow()
        if block.num_rows:
            out = _search_block(documents, block, best)
            found.append(cut(out) if blocks > 1 else out)
    if not found:
        return documents.sparkSession.createDataFrame([], "item_id long, rank int, doc_id long, score long")
    return reduce(DataFrame.unionByName, found)
