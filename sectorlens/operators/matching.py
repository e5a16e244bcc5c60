"""Entity resolution of two registers by name.

All pair work runs on distinct cleaned names: however often a name repeats, it is compared
once, and its rows are attached at the end.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sectorlens.functions.names import clean_name, jaccard_score, levenshtein_score, minhashes, shingles
from sectorlens.operators.crowds import SCORES, crowd_pairs
from sectorlens.operators.joins import spread_join
from sectorlens.operators.ranking import top_per_key
from sectorlens.operators.records import validate_keys
from sectorlens.session import cut


def cleaned(names: DataFrame, id_col: str, clean: bool = True) -> DataFrame:
    """(id, name) with the name cleaned or left as it is."""
    name = clean_name("name") if clean else F.col("name")
    return names.select(F.col(id_col).alias("id"), name.alias("name")).where("name is not null")


def distinct_names(names: DataFrame) -> DataFrame:
    """One row per name, under the first id that bears it."""
    return names.groupBy("name").agg(F.min("id").alias("id")).select("id", "name")


# Candidates by MinHash and locality-sensitive hashing.


def signed_names(names: DataFrame, side: str, bands: int, rows: int, k: int) -> DataFrame:
    """Names with their sizes, ``grams`` and ``keys``, the hash of each band's minhashes."""
    grams = shingles("name", k)
    signed = names.select(F.col("id").alias(side), "name", F.length("name").alias("length"), grams.alias("grams"), minhashes(grams, bands * rows).alias("sig"))
    keys = F.transform(F.sequence(F.lit(0), F.lit(bands - 1)), lambda b: F.xxhash64(F.slice("sig", b * rows + 1, F.lit(rows))))
    values = {"name": F.col("name"), "length": F.col("length"), "size": F.size("grams"), "grams": F.col("grams"), "keys": keys}
    # A name is read once per band, so its signature is computed once and kept.
    return cut(signed.select(side, *[value.alias(f"{name}_{side}") for name, value in values.items()]))


def agree(xs_keys: str, ys_keys: str, bands: int, before: Column | None = None) -> Column:
    """Whether two names have the key of a band in common, of one before ``before`` if given."""
    same = [
        (F.get(xs_keys, F.lit(b)) == F.get(ys_keys, F.lit(b))) & (F.lit(True) if before is None else before > b)
        for b in range(bands)
    ]
    return reduce(or_, same)


def lsh_meetings(xs: DataFrame, ys: DataFrame, bands: int, block: int) -> DataFrame:
    """The rows of two signed names that agree on a band, joined in the first such band only.

    So no pair comes twice, and pairs, which may be many more than names, are never moved.
    """
    banded = [names.select("*", F.posexplode(f"keys_{side}").alias("band", "key")) for names, side in ((xs, "x"), (ys, "y"))]
    met = spread_join(*banded, ["band", "key"], "x", block, few_copies=True)
    return met.where(~agree("keys_x", "keys_y", bands, F.col("band"))).drop("band", "key")


def crowded(xs: DataFrame, ys: DataFrame, share: float = 0.01) -> bool:
    """Whether the buckets of two signed names hold more meetings than this share of all pairs."""
    counts = [names.select(F.posexplode(f"keys_{side}").alias("band", "key")).groupBy("band", "key").agg(F.count("*").alias(f"n_{side}")) for names, side in ((xs, "x"), (ys, "y"))]
    meetings = counts[0].join(counts[1], ["band", "key"]).agg(F.sum(F.col("n_x").cast("double") * F.col("n_y"))).first()[0]
    return (meetings or 0) > share * xs.count() * ys.count()


def by_ids(names: DataFrame, id_col: str) -> tuple[DataFrame, DataFrame | None]:
    """The names whose id is theirs alone; and those that share their id or have none, if any."""
    single = cut(names.groupBy(id_col).count().where("count = 1").select(id_col))
    shared = cut(names.join(single, id_col, "left_anti"))
    return (names, None) if shared.isEmpty() else (names.join(single, id_col, "left_semi"), shared)


def meetings_of_shared(met, xs: DataFrame, ys: DataFrame, shared_xs: DataFrame | None, shared_ys: DataFrame | None) -> list[DataFrame]:
    """(x, y) of ``met`` for the pairs with an id of several names or none; a pair may come twice."""
    all_ys = ys if shared_ys is None else ys.unionByName(shared_ys)
    return [met(*sides).select("x", "y") for sides in ((shared_xs, all_ys), (xs, shared_ys)) if None not in sides]


def score_bound() -> Column:
    """No mean score of two names is higher: sizes bound two of the scores, the third is 100 at most."""

    def ratio(what: str) -> Column:
        low, high = F.least(f"{what}_x", f"{what}_y"), F.greatest(f"{what}_x", f"{what}_y")
        return F.coalesce(F.try_divide(low, high), F.lit(1.0))

    return (ratio("size") + ratio("length") + 1) * 100 / 3


def lsh_candidates(
    left: DataFrame,
    right: DataFrame,
    k: int = 3,
    bands: int = 16,
    rows: int = 4,
    min_score: float = 0,
    block: int = 1_000,
    vectors: DataFrame | None = None,
) -> DataFrame:
    """All pairs (x, y) of names that agree on all minhashes of a band.

    The x of a bucket are dealt by hash into blocks of about ``block``, and its y visit every
    block, so a form shared by many names is spread over tasks. With ``min_score``, pairs whose
    sizes alone rule that mean score out are left away inside the block; no other pair is lost.
    Without, buckets that hold a good part of all pairs meet in cells (:func:`crowds.crowd_pairs`).
    With the names' ``vectors`` too, pairs that can't reach the mean score are not met at all
    (:func:`promising_candidates`).
    """
    if vectors is not None and least_jaccard(min_score) > 0:
        return promising_candidates(left, right, vectors, k, bands, rows, min_score, block)
    (xs, shared_xs), (ys, shared_ys) = (
        by_ids(signed_names(names, side, bands, rows, k), side) for names, side in ((left, "x"), (right, "y"))
    )

    def pairs(xs: DataFrame, ys: DataFrame) -> DataFrame:
        met = lsh_meetings(xs, ys, bands, block)
        return (met.where(score_bound() >= min_score - 1e-6) if min_score > 0 else met).select("x", "y")

    several = meetings_of_shared(pairs, xs, ys, shared_xs, shared_ys)
    single = crowd_pairs(xs, ys) if min_score <= 0 and crowded(xs, ys) else pairs(xs, ys)
    return single.unionByName(union_candidates(*several)) if several else single


def least_jaccard(min_score: float) -> float:
    """Names without a common word need this Jaccard index for the mean score: their cosine is 0."""
    return (3 * min_score - 100) / 100 - 1e-6


def promising_candidates(
    left: DataFrame, right: DataFrame, vectors: DataFrame, k: int, bands: int, rows: int, min_score: float, block: int
) -> DataFrame:
    """The pairs of :func:`lsh_candidates` whose scores may have the mean ``min_score``.

    Such a pair shares a word or many shingles. Cold words are joined by their posting lists; names
    with hot words meet in their buckets; the rest is joined by the rarest shingles of each name.
    """

    def signed(names: DataFrame, side: str) -> DataFrame:
        grams = shingles("name", k)
        sizes = [F.length("name").alias(f"length_{side}"), F.size(grams).alias(f"size_{side}")]
        return cut(names.select(F.col("id").alias(side), *sizes, grams.alias("grams"), minhashes(grams, bands * rows).alias(f"sig_{side}")))

    xs, ys = signed(left, "x"), signed(right, "y")
    words = vectors.select("side", "id", F.explode("terms").alias("t"))

    def holders(side: str, hot: bool) -> DataFrame:
        return words.where((F.col("side") == side) & (F.col("t.hot") == hot)).select(F.col("id").alias(side), "t.term")

    cold = holders("x", False).join(holders("y", False), "term").select("x", "y")
    pairs = cold.unionByName(spelled_alike(xs, ys, least_jaccard(min_score), block)).distinct()
    met = pairs.join(xs.drop("grams"), "x").join(ys.drop("grams"), "y")
    agreed = F.exists(
        F.sequence(F.lit(0), F.lit(bands - 1)),
        lambda b: F.slice("sig_x", b * rows + 1, F.lit(rows)) == F.slice("sig_y", b * rows + 1, F.lit(rows)),
    )
    near = met.where(agreed & (score_bound() >= min_score - 1e-6)).select("x", "y")
    common = [
        names.join(holders(side, True).select(F.col(side).alias("id")), "id", "left_semi")
        for names, side in ((left, "x"), (right, "y"))
    ]
    return near.unionByName(lsh_candidates(*common, k, bands, rows, min_score, block)).distinct()


def spelled_alike(xs: DataFrame, ys: DataFrame, least: float, block: int) -> DataFrame:
    """Pairs (x, y) among which are all with a Jaccard index of ``least`` or more of their ``grams``.

    The shingles of a name are ordered by the pairs that they would give, none for those of one side
    only. Two such names share one of the first ``size - ceil(least * size) + 1`` (prefix filter:
    Chaudhuri et al. 2006). Names that, by their size and their shingles on both sides, fit no size
    of the other side are left away before.
    """
    each = {side: names.select(side, f"size_{side}", F.explode("grams").alias("gram")) for side, names in (("x", xs), ("y", ys))}
    counts = [df.groupBy("gram").agg(F.count("*").alias(f"n_{side}")) for side, df in each.items()]
    frequency = cut(counts[0].join(counts[1], "gram").select("gram", (F.col("n_x") * F.col("n_y")).alias("pairs")))

    def first(side: str) -> DataFrame:
        name, size = W.partitionBy(side), F.col(f"size_{side}")
        placed = each[side].join(frequency, "gram", "left").select(
            side, size, "gram", "pairs",
            F.count("pairs").over(name).alias(f"open_{side}"),
            F.row_number().over(name.orderBy(F.asc_nulls_first("pairs"), "gram")).alias("place"),
        )
        return cut(placed.where((F.col("place") <= size - F.ceil(size * least) + 1) & F.col("pairs").isNotNull()).drop("place", "pairs"))

    shared = F.least("open_x", "open_y")
    fits = shared >= least * (F.col("size_x") + F.col("size_y") - shared)
    firsts = {side: first(side) for side in each}
    kinds = {side: df.select(f"size_{side}", f"open_{side}").distinct() for side, df in firsts.items()}  # by pairs of lengths
    fitting = cut(kinds["x"].join(kinds["y"], fits))
    kept = [df.join(fitting, [f"size_{side}", f"open_{side}"], "left_semi") for side, df in firsts.items()]
    return spread_join(*kept, ["gram"], "x", block).where(fits).select("x", "y").distinct()


# Candidates by top-k cosine of TF-IDF.


def tfidf_vectors(left: DataFrame, right: DataFrame, hot_pairs: int = 1_000_000) -> DataFrame:
    """(side, id, name, terms, norm): word weights of every distinct name, idf over both sides.

    A term is marked hot when joining its two posting lists would give over ``hot_pairs`` pairs.
    """
    names = left.withColumn("side", F.lit("x")).unionByName(right.withColumn("side", F.lit("y")))
    words = names.select("side", "id", "name", F.explode(F.split("name", " ")).alias("term"))
    counts = words.groupBy("side", "id", "name", "term").agg(F.count("*").alias("tf"))
    frequency = counts.groupBy("term").agg(
        F.count("*").alias("df"),
        F.count_if(F.col("side") == "x").alias("df_x"),
        F.count_if(F.col("side") == "y").alias("df_y"),
    )
    total = names.agg(F.count("*").alias("n"))  # a single row
    idf = F.log((1 + F.col("n")) / (1 + F.col("df"))) + 1
    vectors = (
        counts.join(frequency, "term")
        .join(F.broadcast(total))
        .withColumn(
            "entry",
            F.struct("term", (F.col("tf") * idf).alias("w"), (F.col("df_x") * F.col("df_y") > hot_pairs).alias("hot")),
        )
        .groupBy("side", "id", "name")
        .agg(F.sort_array(F.collect_list("entry")).alias("terms"))
        .withColumn("norm", F.sqrt(F.aggregate("terms", F.lit(0.0), lambda s, t: s + t.w * t.w)))
    )
    return cut(vectors)  # read by both candidate and score steps


def _side(vectors: DataFrame, side: str) -> DataFrame:
    return vectors.where(F.col("side") == side).select(
        F.col("id").alias(side), F.col("name").alias(f"name_{side}"),
        F.col("terms").alias(f"terms_{side}"), F.col("norm").alias(f"norm_{side}"),
    )


def _weights(side: str) -> Column:
    return F.map_from_arrays(F.col(f"terms_{side}.term"), F.col(f"terms_{side}.w"))


def _cosine(weights: Column | None = None) -> Column:
    weights = _weights("x") if weights is None else weights
    dot = F.aggregate(
        "terms_y", F.lit(0.0), lambda s, t: s + t.w * F.coalesce(F.try_element_at(weights, t.term), F.lit(0.0))
    )
    return F.round(F.try_divide(dot, F.col("norm_x") * F.col("norm_y")), 9)


def with_vectors(pairs: DataFrame, vectors: DataFrame) -> DataFrame:
    return pairs.join(_side(vectors, "x"), "x").join(_side(vectors, "y"), "y")


def cosine_candidates(vectors: DataFrame, k: int = 10, block: int = 10_000) -> DataFrame:
    """(x, y, cosine): for each y the ``k`` most similar x, ties to the lower x; exact.

    Cold terms: posting lists are joined. Hot terms, which may sit in most names: names with
    the same hot terms form one profile, and over hot terms alone all y of a profile rank the
    x alike, the x of a profile by their norm. So ``k`` x per x-profile and the ``k`` best of
    these per y-profile hold every answer that shares hot terms only, and the work grows with
    the number of profiles, not of names. The x of a hot term are dealt into blocks of about
    ``block``, so that no task holds them all.
    """
    postings = vectors.select("side", "id", F.explode("terms").alias("t")).where("not t.hot")
    cold = (
        postings.where("side = 'x'").select(F.col("id").alias("x"), "t.term")
        .join(postings.where("side = 'y'").select(F.col("id").alias("y"), "t.term"), "term")
        .select("x", "y")
    )
    profiles = vectors.select(
        "side", "id", "norm", F.filter("terms", lambda t: t.hot).alias("hot_terms")
    ).where(F.size("hot_terms") > 0).withColumn("profile", F.to_json("hot_terms"))
    x_best = top_per_key(
        profiles.where("side = 'x'"), ["profile"], [F.col("norm"), F.col("id")], k
    ).select(F.col("id").alias("x"), "norm", F.explode("hot_terms").alias("t"))
    y_profiles = profiles.where("side = 'y'")
    shapes = y_profiles.select("profile", "hot_terms").distinct().select(
        "profile", F.explode("hot_terms").alias("t")
    )
    shared = (
        spread_join(
            x_best.select("x", "norm", "t.term", F.col("t.w").alias("wx")),
            shapes.select("profile", "t.term", F.col("t.w").alias("wy")),
            ["term"], "x", block,
        )
        .groupBy("profile", "x", "norm")
        .agg(F.sum(F.col("wx") * F.col("wy")).alias("dot"))
        .withColumn("score", F.round(F.try_divide("dot", "norm"), 9))
    )
    best = top_per_key(shared, ["profile"], [F.desc("score"), F.col("x")], k).select("profile", "x")
    hot = y_profiles.select(F.col("id").alias("y"), "profile").join(best, "profile").select("x", "y")
    scored = with_vectors(cold.unionByName(hot).distinct(), vectors).select("x", "y", _cosine().alias("cosine"))
    return top_per_key(scored, ["y"], [F.desc("cosine"), F.col("x")], k).drop("rank")


def union_candidates(*candidates: DataFrame) -> DataFrame:
    """Pairs of all generators, each once."""
    return reduce(DataFrame.unionByName, [c.select("x", "y") for c in candidates]).distinct()


@dataclass
class Meetings:
    """Pairs of names, each once: what scores need of both names is beside (x, y) in ``rows``.

    The names of ``crowd``, if any, meet in cells, where they are scored, too.
    """

    rows: DataFrame
    crowd: tuple[DataFrame, DataFrame] | None = None

    def pairs(self) -> DataFrame:
        """(x, y)"""
        rows = self.rows.select("x", "y")
        return rows if self.crowd is None else crowd_pairs(*self.crowd).unionByName(rows)


def union_of_all(
    left: DataFrame, right: DataFrame, vectors: DataFrame, top_k: int = 10, k: int = 3, bands: int = 16, rows: int = 4, block: int = 1_000
) -> tuple[Meetings, DataFrame | None]:
    """The pairs of :func:`lsh_candidates` and :func:`cosine_candidates`, each once, in two parts.

    The first has what scores need of both names, so pairs, which may be many more than names, are
    not moved again. The second, if any, is (x, y) with an id of several names or none.
    """
    def weighed(names: DataFrame, side: str) -> DataFrame:
        signed = signed_names(names, side, bands, rows, k)
        return cut(signed.join(_side(vectors, side).withColumn(f"weights_{side}", _weights(side)), [side, f"name_{side}"], "left"))

    def met(xs: DataFrame, ys: DataFrame) -> DataFrame:
        return lsh_meetings(xs, ys, bands, block)

    (xs, shared_xs), (ys, shared_ys) = (by_ids(weighed(names, side), side) for names, side in ((left, "x"), (right, "y")))
    best = cut(cosine_candidates(vectors, top_k).select("x", "y"))
    far = best.join(xs, "x").join(ys, "y").where(~agree("keys_x", "keys_y", bands))
    pairs = Meetings(far, (xs, ys)) if crowded(xs, ys) else Meetings(met(xs, ys).unionByName(far))
    several = meetings_of_shared(met, xs, ys, shared_xs, shared_ys)
    if not several:
        return pairs, None
    own_best = best.join(xs.select("x"), "x", "left_semi")
    others = best.join(xs.select("x"), "x", "left_anti").unionByName(own_best.join(ys.select("y"), "y", "left_anti"))
    return pairs, union_candidates(*several, others)


# Scores and choice.


def score_pairs(pairs: DataFrame, vectors: DataFrame, k: int = 3, min_score: float = 50) -> DataFrame:
    """The three scores of each pair and their mean, 0 to 100; pairs below ``min_score`` go.

    The two scores of the names come first. Only pairs that could still reach the mean with a cosine
    of 1 meet the vectors.
    """
    names = [_side(vectors, side).select(side, f"name_{side}") for side in ("x", "y")]
    spelled = pairs.join(names[0], "x").join(names[1], "y").select(
        "x", "y",
        jaccard_score(shingles("name_x", k), shingles("name_y", k)).alias("jaccard"),
        levenshtein_score("name_x", "name_y").alias("levenshtein"),
    )
    near = cut(spelled.where((F.col("jaccard") + F.col("levenshtein") + 100) / 3 >= min_score - 1e-6))
    scored = with_vectors(near, vectors).select("x", "y", "jaccard", "levenshtein", (_cosine() * 100).alias("cosine"))
    mean = (F.col("jaccard") + F.col("levenshtein") + F.col("cosine")) / 3
    return scored.withColumn("sim_mean", F.round(mean, 6)).where(F.col("sim_mean") >= min_score)


def score_union(
    pairs: Meetings, others: DataFrame | None, vectors: DataFrame, k: int = 3, min_score: float = 0,
    scores: Sequence[str] = SCORES, digits: int | None = None,
) -> DataFrame:
    """The scores of :func:`score_pairs` for both parts of :func:`union_of_all`, or some of them, rounded to ``digits`` if given.

    Shingles and weights are those of the names' rows, so they are not made anew for every pair.
    ``min_score`` needs all three scores.
    """
    names = [*scores, "sim_mean"] if len(scores) == len(SCORES) else list(scores)

    def shown(scored: DataFrame) -> DataFrame:
        kept = scored.where(F.col("sim_mean") >= min_score) if min_score > 0 else scored  # no score is below 0
        return kept.select("x", "y", *[c if digits is None else F.round(c, digits).alias(c) for c in names])

    both = pairs.rows.withColumn("shared", F.size(F.array_intersect("grams_x", "grams_y")))
    scored = both.select(
        "x", "y",
        (100.0 * F.col("shared") / (F.col("size_x") + F.col("size_y") - F.col("shared"))).alias("jaccard"),
        levenshtein_score("name_x", "name_y").alias("levenshtein"),
        (_cosine(F.col("weights_x")) * 100).alias("cosine"),
    )
    out = shown(scored.withColumn("sim_mean", F.round((F.col("jaccard") + F.col("levenshtein") + F.col("cosine")) / 3, 6)))
    if pairs.crowd is not None:
        crowd = crowd_pairs(*pairs.crowd, scores, digits)
        out = (crowd.where(F.col("sim_mean") >= min_score) if min_score > 0 else crowd).select("x", "y", *names).unionByName(out)
    return out if others is None else out.unionByName(shown(score_pairs(others, vectors, k, min_score)))


def best_matches(pairs: DataFrame) -> DataFrame:
    """For each y the x of the highest mean score; of equals the first x."""
    return top_per_key(pairs.select("x", "y", "sim_mean"), ["y"], [F.desc("sim_mean"), F.col("x")], 1).drop("rank")


def attach_names(best: DataFrame, companies: DataFrame, orgs: DataFrame) -> DataFrame:
    """Ids and names of both sides; a y may match once, an x any number of times.

    The matches are written first, so checking their keys doesn't run the matching again.
    """
    best = cut(best)
    validate_keys(best, ["y"])
    validate_keys(orgs, ["y"])
    validate_keys(companies, ["x"])
    return best.join(orgs, "y").join(companies, "x").select(
        "sim_mean", "org_id", "org_name", "company_number", "company_name"
    )
