"""Line dedup by log templates: a fixed-depth tree, templates, and their support across groups of near copies.

A line's tokens are its runs without blanks; a token with a digit is a variable field. The tree has
fixed depth: the number of tokens, then the first `DEPTH` tokens (variable fields alike), lead to a
leaf. Within a leaf, lines that agree in at least `FIXED` of the later places have a template: it keeps
the tokens all of them share there, the other places are variable fields too. Lines of a leaf are
grouped one template after another, so a leaf holds any number of them, whatever their share of its
lines. Other lines are their own template.

A template recurs if it is found in at least `SHAPES` groups of near copies, however many texts there
are: copies count once, so a group of copies is not boilerplate by itself. Groups are the components of
links between texts whose shingle sets have an estimated Jaccard index of at least `ALIKE`, found by the
leaders of their smallest shingles. Texts that share less, such as a passage of up to two thirds of each,
count one by one. All lines of recurring templates are dropped; a text's other lines stay in order.

Only leaves that recur can hold a recurring template, so only their lines are brought together. Leaves
with more than `BLOCK` distinct lines are cut into blocks of lines that share a segment of their
places. There are two segments more than places that may differ, so all lines of a template share at
least two of them: they meet in those blocks, and in a large block are looked up by another segment.

A null text stays null and has no lines. Lines with fewer than `SHORTEST` tokens stay. Texts are
read whole. Equal texts count once towards a template, however often the rows repeat. All columns
are kept, whatever their names.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sectorlens.llm.arrow import runs, text_slices
from sectorlens.llm.components import components
from sectorlens.llm.words import hashes_between, mix, running_sums, span_hashes, word_spans
from sectorlens.session import cut

SHORTEST = 3
DEPTH = 3
SHAPES = 6  # groups of near copies from which a template recurs
ALIKE = 0.5  # estimated Jaccard index from which two texts are near copies
LEADS = 12  # smallest shingles by which a text meets others
BINS = 256  # shingles of a signature, the smallest of each bin
LONG_ENOUGH = 6  # tokens from which a line can be generalised
FIXED = 0.7
BLOCK = 4096
BITS = 22
SLICE = 1 << 18  # bytes of text at once, so that their arrays stay in the cache
LISTED = 500_000  # hashes of recurring lines that may travel with the tasks, 4 MB
_DIGIT = np.zeros(256, bool)
_DIGIT[48:58] = True
VARIABLE = np.uint64(1)


class Lines:
    """The lines of a slice of texts as hashes."""

    def __init__(self, data: np.ndarray, bounds: np.ndarray):
        breaks = np.flatnonzero(data == 10)
        counts = np.diff(np.searchsorted(breaks, bounds))
        self.text = np.repeat(np.arange(len(counts)), counts + 1)
        head = np.cumsum(counts + 1) - (counts + 1)
        is_head = np.zeros(len(self.text), bool)
        is_head[head] = True
        self.starts = np.empty(len(self.text), np.int64)
        self.starts[head] = bounds[:-1]
        self.starts[~is_head] = breaks + 1
        self.ends = np.empty(len(self.text), np.int64)
        last = np.r_[head[1:], len(self.text)] - 1
        is_last = np.zeros(len(self.text), bool)
        is_last[last] = True
        self.ends[last] = bounds[1:]
        self.ends[~is_last] = breaks
        starts, ends, first = word_spans(data, bounds)
        self.words = span_hashes(data.astype(np.uint64), starts, ends)
        self.first = first
        self.tokens = self.words.copy()
        self.tokens[np.searchsorted(starts, np.flatnonzero(_DIGIT[data]), "right") - 1] = VARIABLE
        self.low = np.searchsorted(starts, self.starts)
        self.high = np.searchsorted(starts, self.ends)
        self.count = self.high - self.low
        total = running_sums(self.tokens)
        self.line = hashes_between(total, self.low, self.high).view(np.int64)
        lead = hashes_between(total, self.low, np.minimum(self.low + DEPTH, self.high))
        self.leaf = mix(lead + self.count.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)).view(np.int64)

    def shingles(self) -> list[np.ndarray]:
        """The sorted distinct hashes of each text's five-word shingles; a shorter text has one of all its words."""
        n = max(0, len(self.words) - 4)
        rolled = np.zeros(n, np.uint64)
        for i in range(5):
            rolled = rolled * np.uint64(0x9E3779B97F4A7C15) + self.words[i : i + n]
        rolled = mix(rolled)
        whole = span_hashes(self.words, self.first[:-1], self.first[1:])
        sets = []
        for i, (low, high) in enumerate(zip(self.first[:-1].tolist(), self.first[1:].tolist(), strict=True)):
            ordered = np.sort(rolled[low : high - 4]) if high - low >= 5 else whole[i : i + (high > low)]
            sets.append(ordered[np.r_[True, ordered[1:] != ordered[:-1]][: len(ordered)]])
        return sets


def with_keys(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``(key, digest, text)``: hashes of the row's id and text and of the text."""
    text = F.col(f"`{text_col}`")
    return docs.select(
        F.xxhash64(F.col(f"`{id_col}`").cast("string"), text).alias("key"), F.xxhash64(text).alias("digest"), text.alias("text")
    )


def line_rows(keyed: DataFrame) -> DataFrame:
    """One row per line: its row's key and digest, its leaf and its hash; and one per text: its digest, smallest shingles and signature."""

    def rows(batches):
        for batch, data, bounds in text_slices(batches, limit=SLICE):
            lines = Lines(data, bounds)
            digest = batch.column("digest").to_numpy(zero_copy_only=False)
            at = lines.count >= SHORTEST
            text = lines.text[at]
            n = len(text)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("key").take(pa.array(text)), pa.array(digest[text]), pa.array(lines.leaf[at]), pa.array(lines.line[at]),
                    pa.array(lines.count[at].astype(np.int32)), pa.nulls(n, pa.list_(pa.int64())), pa.nulls(n, pa.binary()),
                ],
                names,
            )
            different = np.unique(digest, return_index=True)[1]
            sets = lines.shingles()
            sets = [sets[i] for i in different.tolist()]
            n = len(sets)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.nulls(n, pa.int64()), pa.array(digest[different]), *[pa.nulls(n, pa.int64())] * 2, pa.nulls(n, pa.int32()),
                    pa.array([x[:LEADS].view(np.int64) for x in sets], pa.list_(pa.int64())),
                    pa.array([signature(x) for x in sets], pa.binary()),
                ],
                names,
            )

    names = ["key", "digest", "leaf", "line", "tokens", "low", "signature"]
    return keyed.mapInArrow(rows, "key long, digest long, leaf long, line long, tokens int, low array<long>, signature binary")


def signature(shingles: np.ndarray) -> bytes:
    """A byte for the smallest shingle of each bin of the hash range, 0 for an empty bin; the shingles are sorted."""
    out = np.zeros(BINS, np.uint8)
    bins = (shingles >> np.uint64(56)).astype(np.int64)
    first = np.flatnonzero(np.r_[True, bins[1:] != bins[:-1]][: len(bins)])
    out[bins[first]] = 1 + shingles[first] % np.uint64(255)
    return out.tobytes()


def alike(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Which pairs of signatures (a row each) are of near copies."""
    common = ((left == right) & (left > 0)).sum(1)
    return common >= ALIKE * np.maximum(1, ((left > 0) | (right > 0)).sum(1))


def copy_groups(found: DataFrame) -> DataFrame:
    """``(digest, copies)``: the group of each text that is a near copy of another.

    A text is compared with two leaders of each of its smallest shingles, which differ by shingle.
    """
    signed = cut(found.where("line is null").select("digest", "low", "signature").dropDuplicates(["digest"]))
    met = signed.select("digest", F.explode("low").alias("shingle")).withColumn("h", F.xxhash64("digest", "shingle"))
    leaders = met.groupBy("shingle").agg(
        F.min_by("digest", "h").alias("first"), F.max_by("digest", "h").alias("last")
    ).where("first <> last")
    paired = met.join(leaders, "shingle").select("digest", F.explode(F.array("first", "last")).alias("lead"))
    pairs = paired.where("digest <> lead").select(F.least("digest", "lead").alias("a"), F.greatest("digest", "lead").alias("b")).distinct()
    for c in ("a", "b"):
        pairs = pairs.join(signed.select(F.col("digest").alias(c), F.col("signature").alias(f"signature_{c}")), c)

    def rows(batches):
        for batch in batches:
            if batch.num_rows:
                sides = [
                    np.frombuffer(b"".join(batch.column(f"signature_{c}").to_pylist()), np.uint8).reshape(-1, BINS) for c in ("a", "b")
                ]
                yield batch.select(["a", "b"]).filter(pa.array(alike(*sides)))

    links = pairs.mapInArrow(rows, "a long, b long")
    return components(links).select(F.col("node").alias("digest"), F.col("component").alias("copies"))


def per_text(found: DataFrame, groups: DataFrame) -> DataFrame:
    """``(leaf, line, tokens, copies)``: the different lines of each text with its group, itself if it has no near copy."""
    each = found.where("line is not null").select("digest", "leaf", "line", "tokens").distinct().join(groups, "digest", "left")
    return each.select("leaf", "line", "tokens", F.coalesce("copies", "digest").alias("copies")).distinct()


def recurring(found: DataFrame, by: list[str]) -> DataFrame:
    """Add up ``(*by, copies)`` rows: how many groups of near copies have each."""
    return found.select(*by, "copies").distinct().groupBy(*by).agg(F.count("*").alias("shapes"))


def leaf_bitmap(leaves: DataFrame) -> np.ndarray:
    """A bitmap of 2**BITS bits that is set for each leaf; the driver gets its words and no more."""
    place = F.col("leaf").bitwiseAND(F.lit((1 << BITS) - 1))
    words = leaves.select(place.alias("p")).groupBy(F.shiftright("p", 6).alias("word")).agg(
        F.bit_or(F.expr("shiftleft(1L, cast(p & 63 as int))")).alias("bits")
    ).collect()
    bitmap = np.zeros(1 << BITS - 6, np.int64)
    for row in words:
        bitmap[row["word"]] = row["bits"]
    return bitmap


def token_rows(keyed: DataFrame, bitmap: np.ndarray) -> DataFrame:
    """``(leaf, line, tokens)`` of lines whose leaf may be in the bitmap, once per slice."""

    def rows(batches):
        bits = np.unpackbits(bitmap.view(np.uint8), bitorder="little").astype(bool)
        for _, data, bounds in text_slices(batches, limit=SLICE):
            lines = Lines(data, bounds)
            at = np.flatnonzero((lines.count >= LONG_ENOUGH) & bits[lines.leaf & (1 << BITS) - 1])
            at = at[np.unique(lines.line[at], return_index=True)[1]]
            short = lines.tokens.astype(np.uint32)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(lines.leaf[at]), pa.array(lines.line[at]),
                    pa.array([short[a:b].tobytes() for a, b in zip(lines.low[at], lines.high[at], strict=True)], pa.binary()),
                ],
                ["leaf", "line", "tokens"],
            )

    return keyed.mapInArrow(rows, "leaf long, line long, tokens binary")


def needed(width: int) -> tuple[int, list[tuple[int, int]]]:
    """How many later places of a line must agree, and the segments of its later places."""
    places = width - DEPTH
    need = int(np.ceil(FIXED * places - 1e-9))
    marks = np.linspace(0, places, places - need + 3).astype(int).tolist()
    return need, list(zip(marks[:-1], marks[1:], strict=True))


def generalise(tokens: np.ndarray, shared: int = -1, block: int = BLOCK) -> tuple[np.ndarray, np.ndarray]:
    """Templates of distinct lines (a row each; 0 marks a variable field), and which are valid.

    If there are more than ``block`` forms, a line is compared with those that share a segment of
    places other than ``shared``.
    """
    n, width = tokens.shape
    need, segments = needed(width)
    template, valid = tokens.copy(), np.zeros(n, bool)
    template[tokens == np.uint32(VARIABLE)] = 0
    later = template[:, DEPTH:].copy()
    for place in range(later.shape[1]):
        _, kind, counts = np.unique(later[:, place], return_inverse=True, return_counts=True)
        later[counts[kind] < 2, place] = 0
    may = np.flatnonzero((later != 0).sum(1) >= need)
    if not len(may):
        return template, valid
    forms, form_of, weight = np.unique(later[may], axis=0, return_inverse=True, return_counts=True)
    form_of = form_of.reshape(-1)
    postings = []
    if len(forms) > block:
        for i, (low, high) in enumerate(segments):
            if i != shared:
                at = np.flatnonzero((forms[:, low:high] != 0).all(1))
                key = np.zeros(len(forms), np.uint64)
                for place in range(low, high):
                    key = mix(key * np.uint64(0x9E3779B97F4A7C15) + forms[:, place])
                at = at[np.argsort(key[at], kind="stable")]
                postings.append((at, key[at], key, (forms[:, low:high] != 0).all(1)))
    free, found = np.ones(len(forms), bool), np.zeros_like(forms)
    for seed in range(len(forms)):
        if not free[seed]:
            continue
        if postings:
            near = [np.array([seed])]
            for at, ordered, key, whole in postings:
                if whole[seed]:
                    near.append(at[np.searchsorted(ordered, key[seed]) : np.searchsorted(ordered, key[seed], "right")])
            rows = np.unique(np.concatenate(near))
            rows = rows[free[rows]]
        else:
            rows = np.flatnonzero(free)
        agree = (forms[rows] == forms[seed]) & (forms[seed] != 0)
        close = agree.sum(1) >= need
        rows, agree = rows[close], agree[close]
        chosen = np.argsort(-(agree * weight[rows][:, None]).sum(0), kind="stable")[:need]
        own = agree[:, chosen].all(1)
        free[rows[own]] = False
        if weight[rows[own]].sum() > 1:
            found[rows[own]] = np.where(agree[own].all(0), forms[seed], 0)
    template[may, DEPTH:] = found[form_of]
    valid[may] = (found != 0).any(1)[form_of]
    return template, valid


def in_blocks(lines: DataFrame, block: int) -> DataFrame:
    """``(leaf, part, shared, line, tokens)``: lines ``(leaf, lines, line, tokens)`` of large leaves once per segment without a variable field."""

    def rows(batches):
        for batch in batches:
            out = [[], [], [], []]
            sizes, raws = batch.column("lines").to_pylist(), batch.column("tokens").to_pylist()
            for i, (size, raw) in enumerate(zip(sizes, raws, strict=True)):
                parts = [(0, -1)]
                if size > block:
                    parts = []
                    fixed = np.frombuffer(raw, np.uint32)[DEPTH:] != np.uint32(VARIABLE)
                    for j, (low, high) in enumerate(needed(len(raw) // 4)[1]):
                        if fixed[low:high].all():
                            part = hashlib.blake2b(raw[4 * (DEPTH + low) : 4 * (DEPTH + high)], digest_size=8).digest()
                            parts.append((int.from_bytes(part, "little", signed=True), j))
                for part, j in parts:
                    for column, value in zip(out, (i, part, j, raw), strict=True):
                        column.append(value)
            at = pa.array(out[0], pa.int64())
            yield pa.RecordBatch.from_arrays(
                [batch.column("leaf").take(at), pa.array(out[1], pa.int64()), pa.array(out[2], pa.int32()), batch.column("line").take(at), pa.array(out[3], pa.binary())],
                ["leaf", "part", "shared", "line", "tokens"],
            )

    return lines.mapInArrow(rows, "leaf long, part long, shared int, line long, tokens binary")


def templates_of(lines: DataFrame, block: int = BLOCK) -> DataFrame:
    """``(line, template)`` for lines ``(leaf, part, shared, line, tokens)`` whose template is valid."""

    def rows(batches):
        for key, table in runs(batches, ["leaf", "part", "shared"]):
            raw = table.column("tokens").to_pylist()
            width = len(raw[0]) // 4
            tokens = np.stack([np.frombuffer(r, np.uint32, width) for r in raw])
            template, valid = generalise(tokens, key[2], block)
            names = [
                int.from_bytes(hashlib.blake2b(t.tobytes() + key[0].to_bytes(8, "little", signed=True), digest_size=8).digest(), "little", signed=True)
                for t in template[valid]
            ]
            yield pa.RecordBatch.from_arrays(
                [table.column("line").combine_chunks().filter(pa.array(valid)), pa.array(names, pa.int64())], ["line", "template"]
            )

    by = ["leaf", "part", "shared"]
    return lines.repartition(*by).sortWithinPartitions(*by, "line").mapInArrow(rows, "line long, template long")


def recurring_lines(found: DataFrame, keyed: DataFrame, shapes: int = SHAPES, block: int = BLOCK) -> DataFrame:
    """``(line)``: the hashes of all lines whose template recurs."""
    found = cut(per_text(found, cut(copy_groups(found))))
    each = cut(recurring(found, ["leaf", "line"]))
    alone = each.where(F.col("shapes") >= shapes).select("line")
    lines_in = each.groupBy("leaf").agg(F.count("*").alias("lines"))
    leaves = cut(
        recurring(found.where(F.col("tokens") >= LONG_ENOUGH), ["leaf"]).where(F.col("shapes") >= shapes)
        .join(lines_in.where("lines > 1"), "leaf").select("leaf", "lines")
    )
    tokens = token_rows(keyed, leaf_bitmap(leaves)).dropDuplicates(["leaf", "line"]).join(leaves, "leaf")
    assigned = cut(templates_of(in_blocks(tokens.select("leaf", "lines", "line", "tokens"), block), block))
    support = recurring(found.join(assigned, "line"), ["template"])
    general = assigned.join(support.where(F.col("shapes") >= shapes), "template").select("line")
    return alone.union(general).distinct()


def drop_recurring(
    docs: DataFrame, shapes: int = SHAPES, id_col: str = "doc_id", text_col: str = "text",
    n_lines: str | None = None, n_dropped: str | None = None, listed: int = LISTED, block: int = BLOCK,
) -> DataFrame:
    """The same rows and columns without the lines of recurring templates, and if named two counts.

    Up to ``listed`` hashes of recurring lines travel with the tasks; more are joined to the rows that
    hold them, with the same result.
    """
    keyed = with_keys(docs, id_col, text_col)
    found = cut(line_rows(keyed))
    gone_lines = cut(recurring_lines(found, keyed, shapes, block))
    names = docs.columns
    chosen = docs.select(
        F.xxhash64(F.col(f"`{id_col}`").cast("string"), F.col(f"`{text_col}`")).alias("key"),
        *[F.col(f"`{c}`").alias("text" if c == text_col else f"c{i}") for i, c in enumerate(names)],
    )
    known = np.zeros(0, np.int64)
    if gone_lines.count() <= listed:
        known = gone_lines.toPandas()["line"].to_numpy(np.int64)
        chosen = chosen.drop("key")
    else:
        drops = found.where("line is not null").select("key", "line").distinct().join(gone_lines, "line")
        drops = drops.groupBy("key").agg(F.collect_set("line").alias("drops"))
        chosen = chosen.join(cut(drops), "key", "left").drop("key")

    def rows(batches):
        for batch, data, bounds in text_slices(batches, limit=SLICE):
            texts = batch.column("text").to_pylist()
            drop = batch.column("drops").to_pylist() if "drops" in batch.schema.names else [known] * len(texts)
            lines = Lines(data, bounds)
            listed_here = np.isin(lines.line, known)
            marks = np.searchsorted(lines.text, np.arange(len(texts) + 1)).tolist()
            n, gone = np.diff(marks), np.zeros(len(texts), np.int64)
            for i, own in enumerate(drop):
                if texts[i] is None:
                    n[i] = 0
                elif own is not None and len(own):
                    part = slice(marks[i], marks[i + 1])
                    hit = listed_here[part] if own is known else np.isin(lines.line[part], own)
                    out = hit & (lines.count[part] >= SHORTEST)
                    gone[i] = out.sum()
                    if gone[i]:
                        texts[i] = "\n".join(t for t, x in zip(texts[i].split("\n"), out.tolist(), strict=True) if not x)
            arrays = [pa.array(texts, pa.string()) if c == text_col else batch.column(f"c{i}") for i, c in enumerate(names)]
            yield pa.RecordBatch.from_arrays([*arrays, pa.array(n), pa.array(gone)], [f"c{i}" for i in range(len(names) + 2)])

    schema = [f"c{i} {docs.schema[c].dataType.simpleString()}" for i, c in enumerate(names)]
    schema += [f"c{len(names)} long", f"c{len(names) + 1} long"]
    out = chosen.mapInArrow(rows, ", ".join(schema))
    counts = {n_lines: f"c{len(names)}", n_dropped: f"c{len(names) + 1}"}
    return out.select(
        *[F.col(f"c{i}").alias(c) for i, c in enumerate(names)], *[F.col(v).alias(k) for k, v in counts.items() if k]
    )
