"""Quality rules: word counts and repetitions of a text, and lines that a host repeats across documents.

Base rules look at one text: too few words, or too many words inside repeated three-word windows.
The method looks across documents: lines are normalised (A-Z lower-cased, blanks between words made
one space) and hashed, the distinct texts of a host that hold a line are counted, and lines above the
limit are removed from all of the host's documents. A document that is left with too few words, or
with too small a share of its own, is rejected. Equal texts of a host count once, so exact copies
alone remove nothing; they are left to the operators for copies.

The counts are exact over all documents for 64-bit hashes. Removed lines are joined back per host and
line. The lines that hold at least a thousandth of all rows each are at most a thousand, so they are
broadcast; of the others no key is larger than that share of the rows.

A null or empty text has no words and fails the base rules. A null host is a host of its own.
Repeated rows are judged each. Columns other than the id, the text and the host aren't read by
`quality_rules`; `clean` hands all of them on.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sectorlens.llm.arrow import text_slices
from sectorlens.llm.words import hashes_between, mix, running_sums, span_hashes, word_hashes, word_spans
from sectorlens.session import cut

LEAST_WORDS = 50
MOST_REPEATED = 50  # per cent of the words
LINE_LIMIT = 10  # distinct texts of a host
LEAST_LEFT = 30  # per cent of the words
WINDOW = 3
HEAVY = 1000

_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"#*$%&|<>")] = True


def _per_text(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """The sum of the values between neighbouring bounds."""
    total = np.zeros(len(values) + 1, np.int64)
    np.cumsum(values, out=total[1:])
    return total[bounds[1:]] - total[bounds[:-1]]


def _own(hashes: np.ndarray, owner: np.ndarray) -> np.ndarray:
    """Hashes that also tell the texts of a slice apart."""
    return hashes ^ mix(owner.astype(np.uint64) + np.uint64(1))


def repeated_words(words: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Words of each text inside windows that the text holds twice or more; ``words`` are hashes."""
    n = max(0, len(words) - WINDOW + 1)
    rolled = np.zeros(n, np.uint64)
    for i in range(WINDOW):
        rolled = mix(rolled + words[i : i + n])
    owner = np.repeat(np.arange(len(first) - 1), np.diff(first))
    inside = np.flatnonzero(owner[:n] == owner[WINDOW - 1 :])
    _, place, times = np.unique(_own(rolled[inside], owner[inside]), return_inverse=True, return_counts=True)
    covered = np.zeros(len(words), bool)
    twice = inside[times[place] > 1]
    for i in range(WINDOW):
        covered[twice + i] = True
    return _per_text(covered, first)


class Lines:
    """The lines that hold a word: owner, bounds in the data, words, and hashes as written and normalised."""

    def __init__(self, data: np.ndarray, bounds: np.ndarray):
        cuts = np.unique(np.r_[bounds, np.flatnonzero(data == 10) + 1])
        words, _ = word_hashes(data, bounds)
        at = np.searchsorted(word_spans(data, bounds)[0], cuts)
        told = np.flatnonzero(np.diff(at))
        self.low, self.high = cuts[told], cuts[told + 1]  # with the line's end
        self.owner = np.searchsorted(bounds, self.low, "right") - 1
        self.words = np.diff(at)[told]
        sums = running_sums(data.astype(np.uint64))
        self.written = hashes_between(sums, self.low, self.high - (data[self.high - 1] == 10))
        self.normal = span_hashes(words, at[told], at[told + 1])


def measure(numbered: DataFrame, host: str) -> DataFrame:
    """The base columns of each row, a hash of its text, and its distinct normalised lines with their words."""

    def rows(batches):
        for part, data, bounds in text_slices(batches):
            raw = data.astype(np.uint64)
            starts, ends, first = word_spans(data, bounds)
            inside = np.zeros(len(data) + 1, np.int64)
            np.add.at(inside, starts, 1)
            np.add.at(inside, ends, -1)
            in_word = np.cumsum(inside[:-1]).astype(bool)
            sums = running_sums(raw)
            lines = Lines(data, bounds)
            n = len(bounds) - 1
            all_lines = np.bincount(lines.owner, minlength=n)
            written = np.unique(_own(lines.written, lines.owner), return_index=True)[1]
            order = np.lexsort((lines.normal, lines.owner))
            normal, owner = lines.normal[order], lines.owner[order]
            new = np.flatnonzero(np.r_[True, (normal[1:] != normal[:-1]) | (owner[1:] != owner[:-1])][: len(order)])
            words = np.add.reduceat(lines.words[order], new) if len(new) else np.zeros(0, np.int64)
            list_ends = pa.array(np.searchsorted(owner[new], np.arange(n + 1)), pa.int32())
            yield pa.RecordBatch.from_arrays(
                [
                    part.column("row"), part.column("doc_id"), part.column("host"),
                    pa.array(np.diff(first).astype(np.int64)),
                    pa.array(_per_text(in_word & ((data & 0xC0) != 0x80), bounds)),
                    pa.array(_per_text(_SYMBOL[data], bounds)),
                    pa.array(all_lines - np.bincount(lines.owner[written], minlength=n)),
                    pa.array(repeated_words(hashes_between(sums, starts, ends), first)),
                    pa.array(hashes_between(sums, bounds[:-1], bounds[1:]).view(np.int64)),
                    pa.ListArray.from_arrays(list_ends, pa.array(normal[new].view(np.int64))),
                    pa.ListArray.from_arrays(list_ends, pa.array(words.astype(np.int64))),
                ],
                [*_MEASURED],
            )

    chosen = numbered.select("row", F.col("doc_id").cast("long"), F.col(host).cast("string").alias("host"), F.col("text").cast("string"))
    return chosen.mapInArrow(rows, ", ".join(f"{name} {kind}" for name, kind in _MEASURED.items()))


_MEASURED = {
    "row": "long", "doc_id": "long", "host": "string", "n_words": "long", "word_chars": "long", "n_symbols": "long",
    "n_dup_lines": "long", "n_repeat_words": "long", "text_hash": "long", "lines": "array<long>", "line_words": "array<long>",
}


def each_line(measured: DataFrame) -> DataFrame:
    """``(row, text_hash, line, words, key)``: a row per document and distinct line; the key tells hosts apart."""
    lines = measured.select("row", "host", "text_hash", F.inline(F.arrays_zip(F.col("lines").alias("line"), F.col("line_words").alias("words"))))
    return lines.select("row", "text_hash", "line", "words", F.xxhash64("host", "line").alias("key"))


def frequent_lines(lines: DataFrame, limit: int) -> DataFrame:
    """``(key, texts, times)``: the lines that more than ``limit`` distinct texts of a host hold."""
    return (
        lines.groupBy("key").agg(F.count_distinct("text_hash").alias("texts"), F.count("*").alias("times")).where(F.col("texts") > limit)
    )


def removed_lines(measured: DataFrame, limit: int) -> DataFrame:
    """``(row, line, words)``: the lines that go."""
    lines = each_line(measured)
    frequent = cut(frequent_lines(lines, limit))
    total = measured.agg(F.coalesce(F.sum(F.size("lines")), F.lit(0))).first()[0]
    is_heavy = F.col("times") * HEAVY >= total  # so there are at most HEAVY such lines
    heavy, others = frequent.where(is_heavy).select("key"), frequent.where(~is_heavy).select("key")
    gone = lines.join(F.broadcast(heavy), "key", "left_semi").unionByName(lines.join(others, "key", "left_semi"))
    return gone.select("row", "line", "words")


def base_failed(n_words: Column, n_repeat_words: Column) -> Column:
    return (n_words < LEAST_WORDS) | (100 * n_repeat_words > MOST_REPEATED * n_words)


def judge(measured: DataFrame, gone: DataFrame, least_left: int = LEAST_LEFT) -> DataFrame:
    """The measured rows with ``n_words_left``, ``base_failed`` and ``kept``."""
    per_row = gone.groupBy("row").agg(F.sum("words").alias("_gone"))
    left = F.col("n_words") - F.coalesce("_gone", F.lit(0))
    return (
        measured.drop("lines", "line_words").join(per_row, "row", "left")
        .withColumn("n_words_left", left)
        .withColumn("base_failed", base_failed(F.col("n_words"), F.col("n_repeat_words")))
        .withColumn("kept", ~F.col("base_failed") & (left >= LEAST_WORDS) & (100 * left >= least_left * F.col("n_words")))
        .drop("_gone")
    )


RULE_COLUMNS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "n_words_left")


def quality_rules(documents: DataFrame, host: str = "source", limit: int = LINE_LIMIT, least_left: int = LEAST_LEFT) -> DataFrame:
    """``doc_id`` and the columns of all rules for each row; see the module's text."""
    numbered = documents.select(F.monotonically_increasing_id().alias("row"), "doc_id", host, "text")
    measured = cut(measure(numbered, host))
    return judge(measured, removed_lines(measured, limit), least_left).select("doc_id", *RULE_COLUMNS)


def without_lines(data: np.ndarray, bounds: np.ndarray, gone: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """The data and bounds of the texts without the lines whose normalised hashes are listed for each."""
    lines = Lines(data, bounds)
    owner = np.repeat(np.arange(len(gone)), [len(g) for g in gone])
    listed = _own(np.concatenate([*gone, np.zeros(0, np.uint64)]), owner)
    drop = np.isin(_own(lines.normal, lines.owner), listed)
    change = np.zeros(len(data) + 1, np.int64)
    np.add.at(change, lines.low[drop], 1)
    np.add.at(change, lines.high[drop], -1)
    keep = np.cumsum(change[:-1]) == 0
    return data[keep], np.r_[0, np.cumsum(_per_text(keep, bounds))]


def clean(documents: DataFrame, host: str = "source", limit: int = LINE_LIMIT, least_left: int = LEAST_LEFT) -> DataFrame:
    """The kept documents without their removed lines, with the columns they came with.

    Lines go with their line feed. Texts move once, to meet their lists of lines.
    """
    numbered = cut(documents.select(F.struct(*[F.col(f"`{c}`") for c in documents.columns]).alias("d"), F.monotonically_increasing_id().alias("row")))
    texts = numbered.select("row", *[F.col("d").getField(c).alias(n) for c, n in (("doc_id", "doc_id"), (host, "_host"), ("text", "text"))])
    measured = cut(measure(texts, "_host"))
    gone = cut(removed_lines(measured, limit))
    kept = judge(measured, gone, least_left).where("kept").select("row")
    lists = gone.groupBy("row").agg(F.collect_list("line").alias("gone"))  # at most a document's lines

    def rows(batches):
        for part, data, bounds in text_slices(batches):
            listed = [np.array(g or [], np.int64).view(np.uint64) for g in part.column("gone").to_pylist()]
            data, bounds = without_lines(data, bounds, listed)
            made = pa.LargeStringArray.from_buffers(len(bounds) - 1, pa.py_buffer(bounds.astype(np.int64)), pa.py_buffer(data)).cast(pa.string())
            yield pa.RecordBatch.from_arrays([part.column("d"), made], ["d", "text"])

    inner = numbered.schema["d"].dataType
    out = (
        numbered.join(kept, "row", "left_semi").join(lists, "row", "left")
        .select("d", F.col("d.text").alias("text"), "gone")
        .mapInArrow(rows, f"d {inner.simpleString()}, text string")
    )
    return out.select(*[F.col("text") if c == "text" else F.col("d").getField(c).alias(c) for c in documents.columns])
