"""Language identification by segmentation-marginalised unigrams.

Every language has probabilities over the pieces of a fixed public vocabulary. A word's probability
is the sum over all its segmentations into pieces (forward algorithm), a text's is the product over
its words. Probabilities are learned by expectation-maximisation over the counts of all words of
all training documents, which Spark aggregates; only vocabulary size times languages (a small
number) reaches the driver.

Words are runs of letters, lower-cased, with the piece mark in front; words of more than `LONGEST`
letters are segmented in parts of that length. A letter outside the vocabulary has a fixed small
probability in each language.

A null text, or one without a letter, gets `und` and score 0, and so does every text if no training
row has a language. Texts are read whole; repeated rows are scored each, and train with their
number. Equal scores go to the first language by name. Columns other than the id, text and (for
training) language aren't read.
"""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import public_tokenizers
import sentencepiece
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sectorlens.llm.arrow import text_slices
from sectorlens.llm.words import hashes_between, running_sums, span_hashes
from sectorlens.session import cut

VOCABULARY = "piece_bpe_32k.model"
MARK = "▁"
LONGEST = 24
WIDEST = 12  # letters of the widest piece that is used, mark included
UNKNOWN = 1e-9
SMOOTH = 0.05
ROUNDS = 3
UNDECIDED = "und"
AT_ONCE = 8192  # words in a lattice, whose size bounds a task's memory
WORD = re.compile(r"[^\W\d_]+")


def vocabulary_path(name: str = VOCABULARY) -> str:
    return public_tokenizers.path(name)


@lru_cache(maxsize=1)
def pieces_of(path: str) -> tuple[np.ndarray, np.ndarray]:
    """Sorted hashes of the pieces made of letters, and the place of each in that order."""
    model = sentencepiece.SentencePieceProcessor(model_file=path)
    pieces = [model.id_to_piece(i) for i in range(model.get_piece_size())]
    chosen = [p for p in pieces if len(p) <= WIDEST and (p.removeprefix(MARK).isalpha() or p == MARK)]
    points = np.array([ord(c) for p in chosen for c in p], np.uint64)
    ends = np.cumsum([len(p) for p in chosen])
    hashes = np.sort(span_hashes(points, np.r_[0, ends[:-1]], ends))
    return hashes, np.arange(len(hashes))


def words_of(text: str | None) -> list[str]:
    """Lower-cased runs of letters."""
    found = WORD.findall(text.lower()) if text else []
    if "".join(found).isalpha():
        return found
    letters = (w if w.isalpha() else "".join(c for c in w if c.isalpha()) for w in found)
    return [w for w in letters if w]


class Lattice:
    """The pieces that cover each part of some words."""

    def __init__(self, words: list[str], path: str):
        hashes, _ = pieces_of(path)
        marked = [MARK + w for w in words]
        parts = [(i, w[a : a + LONGEST]) for i, w in enumerate(marked) for a in range(0, len(w), LONGEST)]
        parts.sort(key=lambda p: -len(p[1]))
        self.owner = np.array([i for i, _ in parts], np.int64)
        self.n_words = len(words)
        self.sizes = np.array([len(p) for _, p in parts], np.int64)
        flat = np.frombuffer("".join(p for _, p in parts).encode("utf-32-le"), np.uint32).astype(np.uint64)
        sums = running_sums(flat)
        starts = np.cumsum(self.sizes) - self.sizes
        #: at [end][width]: the parts, a leading range since they are sorted by length, and each one's piece or -1.
        self.steps: list[list[np.ndarray]] = []
        for end in range(1, int(self.sizes[0]) + 1 if len(parts) else 1):
            n = int(np.searchsorted(-self.sizes, -end, "right"))
            step = []
            for width in range(1, min(end, WIDEST) + 1):
                at = starts[:n] + end - width
                h = hashes_between(sums, at, at + width)
                place = np.minimum(np.searchsorted(hashes, h), len(hashes) - 1)
                step.append(np.where(hashes[place] == h, place, -1))
            self.steps.append(step)

    def forward(self, table: np.ndarray) -> np.ndarray:
        """Sums over the segmentations of each part's beginnings; ``table`` has a row per piece."""
        alpha = np.zeros((len(self.steps) + 1, len(self.sizes), table.shape[1]))
        alpha[0] = 1
        for end, step in enumerate(self.steps, 1):
            for width, piece in enumerate(step, 1):
                known = np.flatnonzero(piece >= 0)
                alpha[end, known] += alpha[end - width, known] * table[piece[known]]
                if width == 1:
                    other = np.flatnonzero(piece < 0)
                    alpha[end, other] += alpha[end - 1, other] * UNKNOWN
        return alpha

    def log_probability(self, table: np.ndarray) -> np.ndarray:
        """Of each word in each language."""
        out = np.zeros((self.n_words, table.shape[1]))
        if len(self.sizes):
            alpha = self.forward(table)
            logs = np.log(alpha[self.sizes, np.arange(len(self.sizes))])
            for column in range(table.shape[1]):
                out[:, column] = np.bincount(self.owner, logs[:, column], self.n_words)
        return out

    def expected(self, column: np.ndarray, weight: np.ndarray) -> np.ndarray:
        """Expected uses of each piece under one language's probabilities, words weighted."""
        out = np.zeros(len(column))
        if not len(self.sizes):
            return out
        alpha = self.forward(column[:, None])[:, :, 0]
        total = alpha[self.sizes, np.arange(len(self.sizes))]
        beta = np.zeros_like(alpha)
        beta[self.sizes, np.arange(len(self.sizes))] = weight[self.owner] / total
        for end in range(len(self.steps), 0, -1):
            for width, piece in enumerate(self.steps[end - 1], 1):
                known = np.flatnonzero(piece >= 0)
                gain = column[piece[known]] * beta[end, known]
                out += np.bincount(piece[known], gain * alpha[end - width, known], len(column))
                beta[end - width, known] += gain
                if width == 1:
                    other = np.flatnonzero(piece < 0)
                    beta[end - 1, other] += UNKNOWN * beta[end, other]
        return out


def training_rows(docs: DataFrame) -> Column:
    """Three rows in four, by a checksum of the id; the others are held out."""
    return ~held_out()


def held_out(id_col: str = "doc_id") -> Column:
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % 4 == 2, F.lit(False))


def word_counts(docs: DataFrame, text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """``(lang, word, n)`` over all texts with a language."""

    def rows(batches):
        for batch, _, _ in text_slices(batches):
            by_lang: dict[str, Counter] = defaultdict(Counter)
            for text, lang in zip(batch.column("text").to_pylist(), batch.column("lang").to_pylist(), strict=True):
                by_lang[lang].update(words_of(text))
            for lang, counts in by_lang.items():
                yield pa.RecordBatch.from_arrays(
                    [pa.array([lang] * len(counts), pa.string()), pa.array(list(counts), pa.string()), pa.array(list(counts.values()), pa.int64())],
                    ["lang", "word", "n"],
                )

    chosen = docs.where(F.col(lang_col).isNotNull()).select(F.col(text_col).alias("text"), F.col(lang_col).alias("lang"))
    return chosen.mapInArrow(rows, "lang string, word string, n long").groupBy("lang", "word").agg(F.sum("n").alias("n"))


def fit(docs: DataFrame, rounds: int = ROUNDS, path: str | None = None) -> tuple[list[str], np.ndarray]:
    """Languages by name, and a row per piece with its probability in each."""
    path = path or vocabulary_path()
    counts = cut(word_counts(docs))
    languages = [r["lang"] for r in counts.select("lang").distinct().orderBy("lang").collect()]
    size = len(pieces_of(path)[0])
    table = np.full((size, len(languages)), 1 / size)

    for _ in range(rounds if languages else 0):
        current = table

        def rows(batches, current=current):
            place = {lang: i for i, lang in enumerate(languages)}
            total = np.zeros(current.shape)
            for whole in batches:
                frame = whole.to_pandas()
                for lang, part in frame.groupby("lang"):
                    column = current[:, place[lang]]
                    for low in range(0, len(part), AT_ONCE):
                        some = part.iloc[low : low + AT_ONCE]
                        total[:, place[lang]] += Lattice(some["word"].tolist(), path).expected(column, some["n"].to_numpy(np.float64))
            piece, lang = np.nonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array(piece), pa.array(lang), pa.array(total[piece, lang])], ["piece", "lang", "n"])

        found = (
            counts.select("lang", "word", "n").mapInArrow(rows, "piece long, lang long, n double")
            .groupBy("piece", "lang").agg(F.sum("n").alias("n")).toPandas()
        )
        table = np.full(current.shape, SMOOTH)
        table[found["piece"].to_numpy(), found["lang"].to_numpy()] += found["n"].to_numpy()
        table /= table.sum(axis=0)
    return languages, table


class WordLogs:
    """Log probabilities of the words met so far in each language; emptied when there are too many."""

    def __init__(self, table: np.ndarray, path: str, most: int = 300_000):
        self.table, self.path, self.most = table, path, most
        self.clear()

    def clear(self) -> None:
        self.place: dict[str, int] = {}
        self.logs = np.zeros((0, self.table.shape[1]))

    def of(self, texts: list[list[str]]) -> None:
        """Make sure that all words of some texts have a place."""
        unique = dict.fromkeys(chain.from_iterable(texts))
        if len(self.place) + len(unique) > self.most:
            self.clear()
        new = [w for w in unique if w not in self.place]
        self.place.update(zip(new, range(len(self.place), len(self.place) + len(new)), strict=True))
        parts = [Lattice(new[low : low + AT_ONCE], self.path).log_probability(self.table) for low in range(0, len(new), AT_ONCE)]
        self.logs = np.concatenate([self.logs, *parts])


def identify(
    docs: DataFrame, languages: list[str], table: np.ndarray, path: str | None = None,
    id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = (),
) -> DataFrame:
    """``(id, *keep, lang_pred, score)``; the score is the language's share of the text's probability."""
    path = path or vocabulary_path()
    names = [id_col, *keep]

    def rows(batches):
        known = WordLogs(table, path)
        for batch, _, _ in text_slices(batches):
            words = [words_of(t) for t in batch.column("text").to_pylist()]
            known.of(words)
            place = known.place.__getitem__
            chosen, score = [], []
            for own in words:
                if not own or not languages:
                    chosen.append(UNDECIDED)
                    score.append(0.0)
                    continue
                logs = known.logs[np.fromiter(map(place, own), np.int64, len(own))].sum(axis=0)
                shares = np.exp(logs - logs.max())
                chosen.append(languages[int(np.argmax(logs))])
                score.append(float(shares.max() / shares.sum()))
            arrays = [batch.column(f"c{i}") for i in range(len(names))]
            yield pa.RecordBatch.from_arrays(
                [*arrays, pa.array(chosen, pa.string()), pa.array(score, pa.float64())],
                [*[f"c{i}" for i in range(len(names))], "lang_pred", "score"],
            )

    given = docs.select(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(names)], F.col(text_col).alias("text"))
    kinds = ", ".join(f"c{i} {docs.schema[c].dataType.simpleString()}" for i, c in enumerate(names))
    out = given.mapInArrow(rows, f"{kinds}, lang_pred string, score double")
    return out.toDF(*names, "lang_pred", "score")


def predict_documents(docs: DataFrame, path: str | None = None) -> DataFrame:
    """Learn from the documents that aren't held out, and predict all of them."""
    languages, table = fit(docs.where(training_rows(docs)), path=path)
    return identify(docs, languages, table, path).select("doc_id", held_out().alias("held_out"), "lang_pred", "score")
