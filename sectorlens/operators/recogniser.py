"""Entities that no list holds: a first-order sequence model learned from text marked by a gazetteer.

A text is cut into sentences and tokens. Tokens of known names carry the kind of their name, the
others `OUTSIDE`. Counts of neighbouring tags and of tokens per tag are aggregates over the corpus;
a token that was met too rarely counts by its form (case, digits, ending, place in the sentence),
which is how unseen names are told. The most likely tags of a sentence are found by a fold over its
tokens (Viterbi), whose state is a score per tag.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sectorlens.operators.joins import spread_join
from sectorlens.session import cut

OUTSIDE, BEGIN = "O", "^"
TOKEN = r"[\p{L}\p{M}]+|\p{N}+|[^\p{L}\p{M}\p{N}\s]"
SENTENCE_END = r"(?<=[.!?])\s+"
LEAST = 5  # occurrences from which a token counts by itself
ENDING = 3  # letters of the form's ending
SMOOTH = 0.1
HOT = 100_000


def sentences(texts: DataFrame, key: str = "org_id", text: str = "description") -> DataFrame:
    """``(key, sentence, tokens)``; sentences without tokens are left out."""
    parts = texts.select(key, F.posexplode(F.split(F.coalesce(F.col(text), F.lit("")), SENTENCE_END)).alias("sentence", "_part"))
    return parts.select(key, "sentence", F.regexp_extract_all("_part", F.lit(TOKEN), F.lit(0)).alias("tokens")).where(F.size("tokens") > 0)


def form(token: Column, first: Column) -> Column:
    """What a token looks like: its case, its ending, and whether it begins the sentence."""
    upper, lower = F.upper(token), F.lower(token)
    case = (
        F.when(upper == lower, F.when(token.rlike(r"^\p{N}"), "9").otherwise("."))
        .when((token == upper) & (F.length(token) > 1), "XX")
        .when(F.left(token, F.lit(1)) != F.left(lower, F.lit(1)), "Xx")
        .otherwise("x")
    )
    ending = F.when(upper == lower, F.lit("")).otherwise(F.right(lower, F.lit(ENDING)))
    return F.concat_ws("|", case, ending, F.when(first, "1").otherwise("0"))


def tag_names(parts: DataFrame, names: DataFrame, key: str = "org_id") -> DataFrame:
    """``(key, sentence, tokens, tags)``: tokens of known names (tokens, kind) carry their kind.

    Names are found by their first token and then compared whole. Of overlapping names the first in
    the sentence wins, of those that start together the longest; of a name with several kinds the first.
    """
    known = names.where(F.size("tokens") > 0).groupBy("tokens").agg(F.min("kind").alias("kind"))
    known = known.select(F.element_at("tokens", 1).alias("token"), F.col("tokens").alias("name"), "kind")
    starts = parts.select(key, "sentence", F.posexplode("tokens").alias("at", "token"), "tokens")
    hits = starts.join(known, "token").where(F.slice("tokens", F.col("at") + 1, F.size("name")) == F.col("name"))
    hit = F.struct("at", (-F.size("name")).alias("order"), F.size("name").alias("width"), "kind")
    found = hits.groupBy(key, "sentence").agg(F.array_sort(F.collect_list(hit)).alias("hits"))  # at most a sentence's tokens x names
    begin = F.expr("struct(0 as stop, cast(array() as array<struct<at:int,order:int,width:int,kind:string>>) as hits)")
    taken = F.aggregate(
        "hits", begin,
        lambda s, h: F.when(h["at"] < s["stop"], s).otherwise(F.struct((h["at"] + h["width"]).alias("stop"), F.concat(s["hits"], F.array(h)).alias("hits"))),
        lambda s: s["hits"],
    )
    joined = parts.join(found.select(key, "sentence", taken.alias("hits")), [key, "sentence"], "left")

    def tag(_: Column, i: Column) -> Column:
        inside = F.filter("hits", lambda h: (h["at"] <= i) & (i < h["at"] + h["width"]))
        return F.coalesce(F.get(inside, F.lit(0))["kind"], F.lit(OUTSIDE))

    return joined.select(key, "sentence", "tokens", F.transform("tokens", tag).alias("tags"))


def _each(tagged: DataFrame, columns: Sequence[str]) -> DataFrame:
    tags = F.arrays_zip(*[F.col(c) for c in columns]) if len(columns) > 1 else F.transform("tokens", lambda t: F.struct(t.alias("tokens")))
    return tagged.select("*", F.posexplode(tags).alias("at", "_x")).select("*", *[F.col(f"_x.{c}").alias(c[:-1]) for c in columns]).drop("_x")


def transition_counts(tagged: DataFrame) -> DataFrame:
    """``(before, tag, n)``; a sentence begins after `BEGIN`."""
    pairs = F.transform("tags", lambda t, i: F.struct(F.when(i == 0, BEGIN).otherwise(F.get("tags", i - 1)).alias("before"), t.alias("tag")))
    return tagged.select(F.inline(pairs)).groupBy("before", "tag").agg(F.count("*").alias("n"))


def emission_counts(tagged: DataFrame, least: int = LEAST) -> DataFrame:
    """``(symbol, whole, tag, n)``: tokens with at least ``least`` occurrences (whole), and the forms of all distinct tokens.

    Forms count each token once per tag, so that frequent words don't stand for the rare ones.
    """
    each = _each(tagged, ["tokens", "tags"]).select("token", "tag", (F.col("at") == 0).alias("first"))
    counts = cut(each.groupBy("token", "tag", "first").agg(F.count("*").alias("n")))
    often = counts.groupBy("token").agg(F.sum("n").alias("all")).where(F.col("all") >= least).select("token")
    whole = counts.groupBy("token", "tag").agg(F.sum("n").alias("n")).join(often, "token")
    forms = counts.select(form(F.col("token"), F.col("first")).alias("symbol"), "tag").groupBy("symbol", "tag").agg(F.count("*").alias("n"))
    return whole.select(F.col("token").alias("symbol"), F.lit(True).alias("whole"), "tag", "n").unionByName(
        forms.select("symbol", F.lit(False).alias("whole"), "tag", "n")
    )


def log_tables(transitions: DataFrame, emissions: DataFrame, smooth: float = SMOOTH) -> tuple[DataFrame, DataFrame]:
    """``(model, symbols)``: a row with the sorted tags and the logs of their transitions, and the logs of each symbol by tag.

    The numbers of tags are the kinds of names and `OUTSIDE`, so both kinds of arrays are short.
    """
    tags = transitions.where(F.col("tag").isNotNull()).agg(F.sort_array(F.collect_set("tag")).alias("tags"))
    after = transitions.groupBy("before").agg(F.sum("n").alias("total"), F.map_from_entries(F.collect_list(F.struct("tag", "n"))).alias("m"))
    rows = after.crossJoin(F.broadcast(tags)).select(  # one row of tags
        "before",
        F.transform("tags", lambda t: F.log((F.coalesce(F.try_element_at("m", t), F.lit(0)) + F.lit(smooth)) / (F.col("total") + F.lit(smooth) * F.size("tags")))).alias("logs"),
    )
    chances = rows.agg(F.map_from_entries(F.collect_list(F.struct("before", "logs"))).alias("by_tag"))
    no_way = F.transform("tags", lambda _: -F.log(F.size("tags").cast("double")))
    model = tags.crossJoin(F.broadcast(chances)).select(
        "tags",
        F.coalesce(F.try_element_at("by_tag", F.lit(BEGIN)), no_way).alias("begin"),
        F.transform("tags", lambda t: F.coalesce(F.try_element_at("by_tag", t), no_way)).alias("moves"),
    )
    totals = emissions.groupBy("whole", "tag").agg(F.sum("n").alias("total"), F.count("*").alias("kinds"))
    by_kind = totals.groupBy("whole").agg(F.map_from_entries(F.collect_list(F.struct("tag", F.struct("total", "kinds").alias("v")))).alias("t"))
    counts = emissions.groupBy("symbol", "whole").agg(F.map_from_entries(F.collect_list(F.struct("tag", "n"))).alias("m"))

    def log_of(tag: Column) -> Column:
        total, kinds = (F.coalesce(F.try_element_at("t", tag)[c], F.lit(0)) for c in ("total", "kinds"))
        return F.log((F.coalesce(F.try_element_at("m", tag), F.lit(0)) + F.lit(smooth)) / (total + F.lit(smooth) * (kinds + 1)))

    symbols = counts.join(F.broadcast(by_kind), "whole").crossJoin(F.broadcast(tags)).select(  # two rows, one row
        "symbol", "whole", F.transform("tags", log_of).alias("logs")
    )
    return model, symbols


def recognise(parts: DataFrame, model: DataFrame, symbols: DataFrame, key: str = "org_id") -> DataFrame:
    """``(key, sentence, tokens, tags)``: the most likely tags of each sentence; equal ones go to the first tag by name.

    A token or form that was never met says nothing. Each distinct token gets its logs once.
    """
    each = _each(parts, ["tokens"]).select(key, "sentence", "at", "token").withColumn("first", F.col("at") == 0)
    each = cut(each)
    distinct = each.select("token", "first").distinct().withColumn("_form", form(F.col("token"), F.col("first")))
    own = symbols.where("whole").select(F.col("symbol").alias("token"), F.col("logs").alias("_own"))
    forms = symbols.where("not whole").select(F.col("symbol").alias("_form"), F.col("logs").alias("_other"))
    logs = distinct.join(own, "token", "left").join(forms, "_form", "left")
    logs = logs.select("token", "first", F.coalesce("_own", "_other").alias("logs"))
    placed = spread_join(each.withColumn("_row", F.struct(key, "sentence", "at")), logs, ["token", "first"], "_row", HOT)
    rows = placed.groupBy(key, "sentence").agg(F.array_sort(F.collect_list(F.struct("at", "token", "logs"))).alias("x"))  # a sentence

    size = F.size("tags")
    none = F.transform("tags", lambda _: F.lit(0.0))
    numbers = F.sequence(F.lit(0), size - 1)

    def best_before(scores: Column, tag: Column) -> Column:
        ways = F.transform(numbers, lambda b: F.struct(F.round(F.get(scores, b) + F.get(F.get("moves", b), tag), 9).alias("score"), (-b).alias("before")))
        return F.array_max(ways)

    def step(state: Column, token: Column) -> Column:
        heard = F.coalesce(token["logs"], none)
        ways = F.when(
            F.size(state["back"]) == 0,
            F.transform(numbers, lambda t: F.struct(F.round(F.get("begin", t), 9).alias("score"), F.lit(0).alias("before"))),
        ).otherwise(F.transform(numbers, lambda t: best_before(state["scores"], t)))
        return F.struct(
            F.zip_with(ways, heard, lambda w, h: w["score"] + h).alias("scores"),
            F.concat(state["back"], F.array(F.transform(ways, lambda w: -w["before"]))).alias("back"),
        )

    start = F.struct(none.alias("scores"), F.expr("cast(array() as array<array<int>>)").alias("back"))
    walked = rows.crossJoin(F.broadcast(model)).withColumn("walk", F.aggregate("x", start, step))  # one row
    last = -F.array_max(F.transform("walk.scores", lambda s, i: F.struct(F.round(s, 9).alias("s"), (-i).alias("i"))))["i"]
    path = F.aggregate(
        F.reverse(F.slice("walk.back", 2, F.greatest(F.size("x") - 1, F.lit(0)))),
        F.array(last),
        lambda tail, back: F.concat(F.array(F.get(back, F.element_at(tail, 1))), tail),
    )
    return walked.select(key, "sentence", F.transform("x", lambda t: t["token"]).alias("tokens"), F.transform(path, lambda p: F.get("tags", p)).alias("tags"))


def learn(tagged: DataFrame, least: int = LEAST, smooth: float = SMOOTH) -> tuple[DataFrame, DataFrame]:
    """The model and symbol tables of tagged sentences, written once."""
    written = cut(tagged)
    model, symbols = log_tables(cut(transition_counts(written)), cut(emission_counts(written, least)), smooth)
    return cut(model), cut(symbols)


def replace_entities(tagged: DataFrame, key: str = "org_id") -> DataFrame:
    """``(key, text)``: the tokens of a text in order, each run of one kind replaced by the kind."""
    shown = F.transform(
        "tags",
        lambda t, i: F.when(t == OUTSIDE, F.get("tokens", i)).when((i > 0) & (F.get("tags", i - 1) == t), F.lit(None).cast("string")).otherwise(t),
    )
    lines = tagged.select(key, F.struct("sentence", F.array_join(F.filter(shown, lambda s: s.isNotNull()), " ").alias("line")).alias("s"))
    joined = F.array_join(F.transform(F.array_sort(F.collect_list("s")), lambda s: s["line"]), " ")
    return lines.groupBy(key).agg(joined.alias("text"))
