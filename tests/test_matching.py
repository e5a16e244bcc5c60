import math
import random
from collections import Counter

from pyspark.sql import functions as F

from sectorlens.functions.names import clean_name, jaccard_score, levenshtein_score, shingles
from sectorlens.operators import matching as m
from sectorlens.plans.name_matching import match_names
from sectorlens.session import cut


def test_name_expressions(spark):
    df = spark.createDataFrame([("ACME  Widgets (UK) Ltd.", "Ltd"), ("ab", "")], "a string, b string")
    assert [r[0] for r in df.select(clean_name("a")).collect()] == ["acme widgets uk", "ab"]
    assert [r[0] for r in df.select(clean_name("b")).collect()] == ["ltd", ""]
    assert [r[0] for r in df.select(shingles("b")).collect()] == [["Ltd"], [""]]
    pair = spark.createDataFrame([("abcd", "abce")], "a string, b string")
    row = pair.select(jaccard_score(shingles("a"), shingles("b")), levenshtein_score("a", "b")).first()
    assert (round(row[0], 6), row[1]) == (33.333333, 75.0)


def brute_cosine(xs, ys, k):
    names = xs + ys
    df = Counter(w for _, n in names for w in set(n.split()))

    def vector(name):
        return {w: c * (math.log((1 + len(names)) / (1 + df[w])) + 1) for w, c in Counter(name.split()).items()}

    out = set()
    for y, name in ys:
        v = vector(name)
        scored = []
        for x, other in xs:
            u = vector(other)
            dot = sum(v[w] * u.get(w, 0) for w in v)
            if dot:
                norm = math.sqrt(sum(a * a for a in v.values()) * sum(a * a for a in u.values()))
                scored.append((-round(dot / norm, 9), x))
        out |= {(x, y) for _, x in sorted(scored)[:k]}
    return out


def test_cosine_candidates_are_exact_with_hot_terms(spark):
    random.seed(5)
    common, rare = ["alpha", "beta", "gamma"], [f"w{i}" for i in range(40)]

    def names(n, offset):
        made = set()
        while len(made) < n:
            made.add(" ".join(random.sample(common, random.randint(1, 3)) + random.choices(rare, k=random.randint(0, 2))))
        return [(offset + i, s) for i, s in enumerate(sorted(made))]

    xs, ys = names(150, 0), names(60, 0)
    left, right = (spark.createDataFrame(v, "id long, name string") for v in (xs, ys))
    want = brute_cosine(xs, ys, 5)
    for hot_pairs in (0, 200, 10**9):  # all terms hot, the common ones, none
        vectors = m.tfidf_vectors(left, right, hot_pairs)
        for block in (3, 10**6):
            got = {(r.x, r.y) for r in m.cosine_candidates(vectors, 5, block).collect()}
            assert got == want, (hot_pairs, block)


def test_lsh_loses_no_pair_in_split_buckets(spark):
    names = [(i, f"north sea trading house {i:03d}") for i in range(120)]
    df = spark.createDataFrame(names, "id long, name string")
    whole = {(r.x, r.y) for r in m.lsh_candidates(df, df, block=10**6).collect()}
    assert {(i, i) for i, _ in names} <= whole and len(whole) > 120 * 60
    for block in (1, 7, 50):
        assert {(r.x, r.y) for r in m.lsh_candidates(df, df, block=block).collect()} == whole


def test_score_bound_loses_no_match(spark):
    names = [(1, "a"), (2, "ab"), (3, "abcabcabc"), (4, "abcabc"), (5, "north sea trading"), (6, "north sea trade"), (7, "")]
    df = spark.createDataFrame(names, "id long, name string")
    every = m.score_pairs(df.select(F.col("id").alias("x")).join(df.select(F.col("id").alias("y"))), m.tfidf_vectors(df, df), min_score=0)
    sizes = df.select("id", F.length("name").alias("length"), F.size(m.shingles("name", 3)).alias("size"))
    bounded = every.join(sizes.toDF("x", "length_x", "size_x"), "x").join(sizes.toDF("y", "length_y", "size_y"), "y")
    assert bounded.where(m.score_bound() < F.col("sim_mean") - 1e-6).count() == 0


def test_one_changed_letter_in_a_common_form(spark):
    """Names of one form that differ in a single word, with one letter changed on the other side."""
    import random

    rng = random.Random(6)
    words = sorted({"".join(rng.choice("abcdefghijklmnoprstuvw") for _ in range(9)) for _ in range(300)})
    left = [(i, f"{w} construction") for i, w in enumerate(words)]
    right = [(i, f"{w[:4]}x{w[5:]} construction") for i, w in enumerate(words)]
    companies = spark.createDataFrame(left, "company_number long, company_name string")
    orgs = spark.createDataFrame(right, "org_id long, org_name string")
    got = match_names(companies, orgs).collect()
    assert sum(r.org_id == r.company_number for r in got) >= 0.99 * len(words)


def test_match_names(spark):
    companies = spark.createDataFrame(
        [(0, "Northern Steel Ltd"), (1, "NORTHERN STEEL LIMITED"), (2, "Bakery of Leeds plc"), (3, "Quick Couriers")],
        "company_number long, company_name string",
    )
    orgs = spark.createDataFrame(
        [(10, "northern steel"), (11, "Northern Steel"), (12, "Leeds Bakery"), (13, "zzz"), (14, "Quick Courier")],
        "org_id long, org_name string",
    )
    found = match_names(companies, orgs, clean=True)
    assert found.columns == ["sim_mean", "org_id", "org_name", "company_number", "company_name"]
    got = {r.org_id: (r.company_number, r.sim_mean) for r in found.collect()}
    assert got[10] == got[11] == (0, 100.0)
    assert got[14][0] == 3 and 13 not in got


def test_promising_candidates_lose_no_match(spark):
    random.seed(11)
    words = ["alpha", "alphas", "alpho", "beta", "gamma", "gammas", "delta", "common", "trade", "traders"]
    names = sorted({" ".join(random.sample(words, random.randint(1, 3))) for _ in range(120)})
    left = spark.createDataFrame(list(enumerate(names[::2])), "id long, name string")
    right = spark.createDataFrame(list(enumerate(names[1::2] + names[:6:2])), "id long, name string")
    for hot_pairs in (1, 100_000):
        vectors = m.tfidf_vectors(left, right, hot_pairs)
        for min_score in (50, 70):
            every = m.score_pairs(m.lsh_candidates(left, right), vectors, min_score=min_score)
            found = m.score_pairs(m.lsh_candidates(left, right, min_score=min_score, vectors=vectors), vectors, min_score=min_score)
            want = {(r.x, r.y, r.sim_mean) for r in every.collect()}
            assert want and {(r.x, r.y, r.sim_mean) for r in found.collect()} == want


def test_promising_candidates_meet_no_crowd(spark):
    left = spark.createDataFrame([(i, f"customer {i:09d}") for i in range(60)], "id long, name string")
    right = spark.createDataFrame([(i, f"supplier {i:09d} 7") for i in range(60)], "id long, name string")
    found = m.lsh_candidates(left, right, min_score=50, vectors=m.tfidf_vectors(left, right))
    assert all(r.x == r.y for r in found.collect()) and m.lsh_candidates(left, right, min_score=50).count() > 1000


def test_best_match_ties_go_to_the_first(spark):
    pairs = spark.createDataFrame([(5, 1, 90.0), (3, 1, 90.0), (4, 1, 80.0)], "x long, y long, sim_mean double")
    assert [tuple(r) for r in m.best_matches(pairs).collect()] == [(3, 1, 90.0)]


def test_score_limit_is_inclusive(spark):
    left = spark.createDataFrame([(1, "abc")], "id long, name string")
    vectors = m.tfidf_vectors(left, left)
    pair = spark.createDataFrame([(1, 1)], "x long, y long")
    assert m.score_pairs(pair, vectors, min_score=100).count() == 1
    assert m.union_candidates(pair, pair.withColumn("z", F.lit(1))).count() == 1


def test_all_pairs_are_scored_where_they_meet(spark):
    """No pair is moved to be told from its repeats; ids of several names, or none, lose and double nothing."""
    names = [f"north sea trading house {i:02d}" for i in range(24)] + ["baker", "sea", "zq"]
    left = spark.createDataFrame([*enumerate(names), (3, "north sea house"), (None, "south sea house")], "id long, name string").coalesce(1)
    right = spark.createDataFrame([*enumerate(names[::-1]), (5, "north sea 11"), (None, "south sea")], "id long, name string").coalesce(1)
    own = left.where("id <> 3"), right.where("id <> 5")
    for xs, ys in ((left, right), own):
        vectors = m.tfidf_vectors(xs, ys)
        lsh, best = m.lsh_candidates(xs, ys, block=4), m.cosine_candidates(vectors, 3)
        assert lsh.count() == lsh.distinct().count()
        pairs, others = m.union_of_all(xs, ys, vectors, 3, block=4)
        assert (others is None) == (xs is not left)
        want = cut(m.union_candidates(lsh, best))
        scored = m.score_union(pairs, others, vectors)
        assert sorted(map(str, scored.collect())) == sorted(map(str, m.score_pairs(want, vectors, min_score=0).collect()))
    plan = lsh._jdf.queryExecution().optimizedPlan().toString()
    assert "Aggregate [x#" not in plan
