"""URL filter: host and path rules, else naive Bayes over segmented host and path words.

Rules decide where one fits; the longest wins. For the other urls, host labels and path parts are
split into words by a unigram Viterbi segmentation (word counts come from the pages' own texts), and
multinomial naive Bayes scores them. It learns from the urls that a rule decides.

The dictionary are all words of the pages' texts, of 2 to `LONGEST` letters. Each distinct name is
split once: its substrings are joined to the word counts, so a task meets only the words that a name
can hold, and the urls are joined to their names. Words are hashed into `BUCKETS` buckets, so the
driver gets two counts per bucket.

A null url, or one without ``://``, has empty host and path. Where rules decide no url, or all alike,
the method's verdict is `allow`, or theirs. Repeated rows are judged each. Columns other than the
id, url and html aren't read.
"""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter
from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sectorlens.operators.joins import spread_join
from sectorlens.session import cut

ALLOW, BLOCK = "allow", "block"
BUCKETS = 1 << 16
LONGEST = 20
HOT = 100_000  # urls of one name in a task
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


@dataclass(frozen=True)
class UrlRule:
    """`text` is a host, a slash and the rest of a path; the host stands for its subdomains too."""

    text: str
    verdict: str

    @property
    def host(self) -> str:
        return self.text.partition("/")[0]

    @property
    def path(self) -> str:
        return self.text[len(self.host) :]


RULES = (
    UrlRule("org/", ALLOW),
    UrlRule("example.org/es/", BLOCK),
    UrlRule("example.org/en/1", BLOCK),
    UrlRule("com/fr/", ALLOW),
    UrlRule("com/de/", BLOCK),
)


def host_and_path(url: Column) -> tuple[Column, Column]:
    rest = F.when(F.contains(url, F.lit("://")), F.substring(url, F.instr(url, "://") + 3, F.length(url)))
    rest = F.coalesce(rest, F.lit(""))
    host = F.translate(F.regexp_extract(rest, r"^[^/?#]*", 0), UPPER, LOWER)
    return host, F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def rule_of(rules: Sequence[UrlRule]) -> Column:
    """The text of the longest rule that fits the columns `host` and `path`, else null."""
    out = F.lit(None).cast("string")
    for rule in sorted(rules, key=lambda r: len(r.text)):
        own = (F.col("host") == rule.host) | F.endswith("host", F.lit(f".{rule.host}"))
        out = F.when(own & F.startswith("path", F.lit(rule.path)), F.lit(rule.text)).otherwise(out)
    return out


def word_counts(html: DataFrame, column: str = "html") -> DataFrame:
    """``(word, n)`` of the pages' texts."""
    plain = F.lower(F.regexp_replace(F.coalesce(column, F.lit("")), r"<[^>]*>", " "))
    each = html.select(F.explode(F.split(plain, r"[^a-z]+")).alias("word"))
    return each.where(F.length("word").between(2, LONGEST)).groupBy("word").agg(F.count("*").alias("n"))


class Segmenter:
    """Splits a concatenated name into its most probable words."""

    def __init__(self, counts: dict[str, int], total: int | None = None):
        total = (sum(counts.values()) if total is None else total) + 1
        self.logs = {w: math.log(n / total) for w, n in counts.items()}
        self.unknown = -math.log(total) - math.log(10)

    def split(self, name: str) -> list[str]:
        best, back = [0.0], [0]
        for end in range(1, len(name) + 1):
            # A letter outside every word costs more than any word.
            options = [(best[end - 1] + self.unknown, end - 1)]
            for start in range(max(0, end - LONGEST), end - 1):
                log = self.logs.get(name[start:end])
                if log is not None:
                    options.append((best[start] + log, start))
            score, start = max(options, key=lambda o: (o[0], -o[1]))
            best.append(score)
            back.append(start)
        words, end = [], len(name)
        while end:
            words.append(name[back[end] : end])
            end = back[end]
        return words[::-1]


def split_names(names: DataFrame, words: DataFrame) -> DataFrame:
    """``(name, words)``: each distinct name split by the counts (word, n) of all words."""
    total = words.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    size = F.length("name")
    parts = names.where(size > 1).select("name", F.explode(F.sequence(F.lit(1), size - 1)).alias("start")).select(
        "name", F.explode(F.transform(
            F.sequence(F.lit(2), F.least(F.lit(LONGEST), size - F.col("start") + 1)), lambda k: F.substring("name", F.col("start"), k)
        )).alias("word")
    )
    held = parts.distinct().join(words, "word").groupBy("name").agg(F.collect_list(F.struct("word", "n")).alias("held"))  # substrings of a name

    def rows(batches):
        for batch in batches:
            found = [
                Segmenter({h["word"]: h["n"] for h in held or ()}, total).split(name)
                for name, held in zip(batch.column("name").to_pylist(), batch.column("held").to_pylist(), strict=True)
            ]
            yield pa.RecordBatch.from_arrays([batch.column("name"), pa.array(found, pa.list_(pa.string()))], ["name", "words"])

    return names.join(held, "name", "left").select("name", "held").mapInArrow(rows, "name string, words array<string>")


def names_in(host: str, path: str) -> tuple[str, list[str], list[str]]:
    """The last host label, and the runs of letters or digits of the other labels and of the path."""
    labels = host.split(":")[0].split(".")
    runs = [part for label in labels[:-1] for part in re.findall(r"[^\W\d_]+|\d+", label)]
    return labels[-1], runs, re.findall(r"[^\W\d_]+|\d+", path.lower())


def tokens(host: str, path: str, splits: dict[str, list[str]]) -> list[str]:
    """Words of the host and of the path, numbers as ``#``; the last host label stays whole."""
    last, *both = names_in(host, path)
    found = [f"h:.{last}"]
    for kind, runs in zip("hp", both):
        for part in runs:
            found += [f"{kind}:#"] if part[0].isdigit() else [f"{kind}:{w}" for w in splits[part]]
    return found


def url_names(urls: DataFrame) -> DataFrame:
    """``(row, name)``: the distinct runs of letters in the host and path of each row."""

    def rows(batches):
        for batch in batches:
            found = [
                sorted({x for runs in names_in(h, p)[1:] for x in runs if not x[0].isdigit()})
                for h, p in zip(batch.column("host").to_pylist(), batch.column("path").to_pylist(), strict=True)
            ]
            at = np.repeat(np.arange(len(found)), [len(f) for f in found])
            yield pa.RecordBatch.from_arrays(
                [batch.column("row").take(pa.array(at)), pa.array([x for f in found for x in f], pa.string())], ["row", "name"]
            )

    return urls.select("row", "host", "path").mapInArrow(rows, "row long, name string")


def bucket(token: str) -> int:
    return zlib.crc32(token.encode()) % BUCKETS


def fit(judged: DataFrame) -> tuple[np.ndarray, float]:
    """Per bucket the log odds of `block`, and the prior's, from `host`, `path`, `splits` and `verdict`."""

    def rows(batches):
        for batch in batches:
            found: Counter = Counter()
            for host, path, splits, verdict in zip(*(batch.column(c).to_pylist() for c in ("host", "path", "splits", "verdict")), strict=True):
                found[verdict == BLOCK, -1] += 1
                found.update((verdict == BLOCK, bucket(t)) for t in tokens(host, path, dict(splits or ())))
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([k[0] for k in found], pa.bool_()), pa.array([k[1] for k in found], pa.int32()),
                    pa.array(list(found.values()), pa.int64()),
                ],
                ["block", "bucket", "n"],
            )

    counted = judged.mapInArrow(rows, "block boolean, bucket int, n long").groupBy("block", "bucket").agg(F.sum("n").alias("n"))
    table, urls = np.ones((2, BUCKETS)), np.zeros(2)
    for row in counted.collect():
        if row["bucket"] < 0:
            urls[int(row["block"])] = row["n"]
        else:
            table[int(row["block"]), row["bucket"]] += row["n"]
    if not urls.all():  # one verdict alone leaves nothing to weigh
        return np.zeros(BUCKETS), math.inf if urls[1] else -math.inf
    odds = np.log(table[1] / table[1].sum()) - np.log(table[0] / table[0].sum())
    return odds, math.log(urls[1] / urls[0])


def judge(
    pages: DataFrame, rules: Sequence[UrlRule] = RULES, id_col: str = "page_id", url_col: str = "url", html_col: str = "html"
) -> DataFrame:
    """``(id, host, path, rule, verdict, score)``; the score is the method's probability of `block`."""
    kind = pages.schema[id_col].dataType.simpleString()
    host, path = host_and_path(F.col(url_col))
    urls = pages.select(F.col(id_col).alias("id"), host.alias("host"), path.alias("path")).withColumn("rule", rule_of(rules))
    verdicts = F.create_map(*[F.lit(x) for r in rules for x in (r.text, r.verdict)]) if rules else F.create_map()
    told = urls.withColumn("ruled", F.element_at(verdicts, F.col("rule")) if rules else F.lit(None).cast("string"))
    told = cut(told.withColumn("row", F.monotonically_increasing_id()))
    each = cut(url_names(told))
    splits = cut(split_names(each.select("name").distinct(), cut(word_counts(pages.select(html_col), html_col))))
    per_row = spread_join(each, splits, ["name"], "row", HOT).groupBy("row").agg(F.map_from_entries(F.collect_list(F.struct("name", "words"))).alias("splits"))
    ruled = cut(told.join(per_row, "row", "left"))
    odds, prior = fit(ruled.where("ruled is not null").select("host", "path", "splits", F.col("ruled").alias("verdict")))

    def rows(batches):
        for batch in batches:
            hosts, paths, splits, own = (batch.column(c).to_pylist() for c in ("host", "path", "splits", "ruled"))
            scores = []
            for h, p, s in zip(hosts, paths, splits, strict=True):
                logit = prior + sum(odds[bucket(t)] for t in tokens(h, p, dict(s or ())))
                scores.append(1 / (1 + math.exp(-min(700, max(-700, logit)))))
            verdict = [v or (BLOCK if s > 0.5 else ALLOW) for v, s in zip(own, scores, strict=True)]
            yield pa.RecordBatch.from_arrays(
                [*[batch.column(c) for c in ("id", "host", "path", "rule")], pa.array(verdict, pa.string()), pa.array(scores, pa.float64())],
                ["id", "host", "path", "rule", "verdict", "score"],
            )

    out = ruled.drop("row").mapInArrow(rows, f"id {kind}, host string, path string, rule string, verdict string, score double")
    return out.withColumnRenamed("id", id_col)
