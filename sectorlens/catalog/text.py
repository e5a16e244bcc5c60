"""Tokens and n-grams of the documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from sectorlens.catalog.registry import Tables, query
from sectorlens.functions import markup as mk
from sectorlens.functions import text as x
from sectorlens.operators import phrases
from sectorlens.plans.descriptions import description_tokens, ngram_tokens, tokenized
from sectorlens.sources import store
from sectorlens.session import cut, scratch_path


def quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def strip_html_sql(column: str) -> str:
    text = column
    for pattern in x.HTML_PATTERNS:
        text = f"regexp_replace({text}, {quoted(pattern)}, '', 'g')"
    return decoded_sql(text)


def decoded_sql(text: str) -> str:
    names = "[" + ", ".join(quoted(n) for n in x.REFERENCES) + "]"
    characters = "[" + ", ".join(quoted(c) for c in x.REFERENCES.values()) + "]"
    name = f"regexp_extract(p, '{x.NAMED}', 1)"
    after = "substr(p, strpos(p, ';') + 1)"
    part = f"""lambda p: case
      when regexp_matches(p, '{x.DECIMAL}') then chr(regexp_extract(p, '{x.DECIMAL}', 1)::int) || {after}
      when regexp_matches(p, '{x.HEX}') then chr(('0x' || regexp_extract(p, '{x.HEX}', 1))::int) || {after}
      when list_contains({names}, {name}) then {characters}[list_position({names}, {name})] || {after}
      else '&' || p end"""
    return f"list_aggregate(list_concat([string_split({text}, '&')[1]], list_transform(string_split({text}, '&')[2:], {part})), 'string_agg', '')"


def mark_sql(column: str) -> str:
    text = f"lower({column})"
    for kind, pattern in x.ENTITY_PATTERNS:
        text = f"regexp_replace({text}, {quoted(pattern)}, ' {kind} ', 'g')"
    return text


STOPS = ", ".join(quoted(w) for w in x.STOP_WORDS)


def lemma_sql(token: str) -> str:
    def ends(endings):
        return "(" + " or ".join(f"ends_with({token}, '{e}')" for e in endings) + ")"

    numbers = " ".join(f"when {token} in ({', '.join(map(quoted, words))}) then '{kind}'" for kind, words in x.NUMBER_WORDS.items())
    return f"""case {numbers} when not ends_with({token}, 's') or length({token}) < 4 then {token}
      when ends_with({token}, 'ies') and length({token}) > 4 then left({token}, length({token}) - 3) || 'y'
      when {ends(x.ES_ENDINGS)} and length({token}) > 4 then left({token}, length({token}) - 2)
      when {ends(x.KEPT_ENDINGS)} then {token} else left({token}, length({token}) - 1) end"""


def tokenize_sql(column: str) -> str:
    words = f"regexp_extract_all({mark_sql(column)}, '{x.TOKEN_PATTERN}')"
    return f"list_transform(list_filter({words}, lambda w: w not in ({STOPS})), lambda w: {lemma_sql('w')})"


@query("f1_strip_html", f"select page_id, {strip_html_sql('html')} as text from pages")
def f1(t):
    return t.pages.select("page_id", x.strip_html("html").alias("text"))


STRIPPED_MARKUP = f"regexp_replace(html, {quoted(mk.lexer('*'))}, '\\1\\2', 'g')"


@query("f1_strip_markup", f"select page_id, {decoded_sql(STRIPPED_MARKUP)} as text from pages")
def f1_markup(t):
    return t.pages.select("page_id", mk.strip_markup("html").alias("text"))


@query("f3_mark_entities", f"select doc_id, {mark_sql('text')} as text from documents")
def f3(t):
    return t.documents.select("doc_id", x.mark_entities("text").alias("text"))


@query("f2_tokenize", f"select doc_id, array_to_string({tokenize_sql('text')}, ' ') as tokens from documents")
def f2(t):
    return t.documents.select("doc_id", F.array_join(x.tokenize("text"), " ").alias("tokens"))


@query(
    "f4_filter_tokens",
    f"""with w as (select doc_id, regexp_extract_all(lower(text), '{x.TOKEN_PATTERN}') as w from documents),
    p as (select doc_id, list_transform(range(1, len(w)), lambda i: w[i] || '_' || w[i + 1]) as p, w from w)
    select doc_id, array_to_string(list_filter(list_concat(w, p), lambda t: length(t) > 2 and t not in ({STOPS})
      and not (len(string_split(t, '_')) = 2 and string_split(t, '_')[1] in ({STOPS})
               and string_split(t, '_')[2] in ({STOPS}))), ' ') as tokens from p""",
)
def f4(t):
    words = t.documents.select(
        "doc_id", F.regexp_extract_all(F.lower("text"), F.lit(x.TOKEN_PATTERN), F.lit(0)).alias("w")
    )
    pairs = F.expr(
        "if(size(w) > 1, transform(sequence(1, size(w) - 1), i -> concat(w[i - 1], '_', w[i])), cast(array() as array<string>))"
    )
    return words.select("doc_id", F.array_join(x.filter_tokens(F.concat("w", pairs)), " ").alias("tokens"))


@query(
    "f11_token_count",
    f"""select 'document' as kind, doc_id as id, 0::bigint as turn,
      len(regexp_extract_all(text, '{x.LENGTH_PATTERN}'))::int as n_tokens from documents
    union all select 'conversation', conv_id, turn,
      len(regexp_extract_all(text, '{x.LENGTH_PATTERN}'))::int from conversations""",
)
def f11(t):
    documents = t.documents.select(F.lit("document").alias("kind"), F.col("doc_id").alias("id"), F.lit(0).cast("long").alias("turn"), "text")
    turns = t.conversations.select(F.lit("conversation").alias("kind"), F.col("conv_id").alias("id"), "turn", "text")
    return documents.unionByName(turns).select("kind", "id", "turn", x.token_count("text").alias("n_tokens"))


def described(t: Tables):
    return t.documents.select(F.col("doc_id").alias("org_id"), F.col("text").alias("description"))


def corpus(t: Tables):
    return cut(tokenized(described(t)))


# Names from a gazetteer in sentences made of supplier, nation and region names.

TRADERS = """traders as (
  select s_suppkey as org_id, lower('Traders of ' || replace(n_name, '_', ' no ') || ' and ' || r_name || ' and of the middle ' || r_name || ' east') as description
  from supplier join nation on s_nationkey = n_nationkey join region on n_regionkey = r_regionkey)"""


def traders(t: Tables):
    nation = F.replace("n_name", F.lit("_"), F.lit(" no "))
    text = F.concat(F.lit("Traders of "), nation, F.lit(" and "), "r_name", F.lit(" and of the middle "), "r_name", F.lit(" east"))
    areas = t.nation.join(t.region, F.col("n_regionkey") == F.col("r_regionkey"))
    placed = t.supplier.join(areas, F.col("s_nationkey") == F.col("n_nationkey"))
    return placed.select(F.col("s_suppkey").alias("org_id"), F.lower(text).alias("description"))


def gazetteer(t: Tables):
    return t.region.select(F.col("r_name").alias("name"), F.lit("LOC").alias("kind")).union(
        t.nation.select(F.split_part("n_name", F.lit("_"), F.lit(1)), F.lit("GPE"))
    )


@query(
    "f3_gazetteer",
    f"""with {TRADERS}, words as (select org_id, {tokenize_sql('description')} as w from traders),
    names as (
      select array_to_string({tokenize_sql('name')}, ' ') as name, min(kind) as kind from (
        select r_name as name, 'LOC' as kind from region
        union all select split_part(n_name, '_', 1), 'GPE' from nation) group by 1),
    ordered as (select list({{'n': ' ' || name || ' ', 'k': ' ' || kind || ' '}} order by length(name) desc, name) as all_names from names)
    select org_id, trim(list_reduce(list_transform(all_names, lambda g: ' ' || array_to_string(w, ' ') || ' '), lambda a, b, i:
      replace(a, all_names[i].n, all_names[i].k), ' ' || array_to_string(w, ' ') || ' ')) as tokens from words, ordered""",
)
def f3_gazetteer(t):
    return joined(tokenized(traders(t), gazetteer=gazetteer(t)))


CORPUS = f"""corpus as (select doc_id as org_id, {tokenize_sql(strip_html_sql('text'))} as tokens from documents)"""


def joined(df):
    return df.select("org_id", F.array_join("tokens", " ").alias("tokens"))


def filter_sql(src: str, out: str, below: int, above: float, keep_n: int | None = None) -> str:
    top = f"qualify row_number() over (order by df desc, token) <= {keep_n}" if keep_n else ""
    return f"""{out}_df as (
  select token, count(*) as df from (select unnest(list_distinct(tokens)) as token from {src}) group by 1),
{out}_keep as (
  select token, df from {out}_df where df >= {below} and df <= {above} * (select count(*) from {src}) {top}),
{out}_pos as (select org_id, unnest(tokens) as token, unnest(range(1, len(tokens) + 1)) as pos from {src}),
{out}_left as (
  select org_id, list(token order by pos) as tokens from {out}_pos semi join {out}_keep using (token) group by 1),
{out} as (select org_id, coalesce(l.tokens, []) as tokens from {src} left join {out}_left l using (org_id))"""


def phrase_sql(src: str, out: str) -> str:
    return f"""{out}_u as (select token, count(*) as n from (select unnest(tokens) as token from {src}) group by 1),
{out}_p as (
  select org_id, i as pos, tokens[i] as first, tokens[i + 1] as second
  from (select org_id, tokens, unnest(range(1, len(tokens))) as i from {src})),
{out}_b as (select first, second, count(*) as n from {out}_p group by all),
{out}_n as (select sum(n) as total from {out}_u),
{out}_a as (
  select b.first, b.second, b.n::bigint as n,
    round(ln((b.n / total) / ((f.n / total) * (s.n / total))) / -ln(b.n / total), 9) as npmi
  from {out}_b b join {out}_u f on f.token = b.first join {out}_u s on s.token = b.second, {out}_n where b.n >= 2),
{out}_f as (
  select org_id, pos, pos - row_number() over (partition by org_id order by pos) as island
  from {out}_p semi join (select * from {out}_a where npmi > 0.25) using (first, second)),
{out}_s as (
  select org_id, pos from {out}_f qualify row_number() over (partition by org_id, island order by pos) % 2 = 1),
{out}_t as (
  select d.org_id, i as pos, tokens[i] as token, tokens[i + 1] as next, s.pos is not null as start,
    coalesce(lag(s.pos is not null) over (partition by d.org_id order by i), false) as used
  from (select org_id, tokens, unnest(range(1, len(tokens) + 1)) as i from {src}) d
    left join {out}_s s on s.org_id = d.org_id and s.pos = d.i),
{out}_l as (
  select org_id, list(case when start then token || '_' || next else token end order by pos) as tokens
  from {out}_t where not used group by 1),
{out} as (select org_id, coalesce(l.tokens, []) as tokens from {src} left join {out}_l l using (org_id))"""


def useful_sql(src: str, out: str) -> str:
    return f"""{out} as (
  select org_id, list_filter(tokens, lambda t: length(t) > 2 and t not in ({STOPS})
      and not (len(string_split(t, '_')) = 2 and string_split(t, '_')[1] in ({STOPS})
               and string_split(t, '_')[2] in ({STOPS}))) as tokens from {src})"""


@query(
    "a13_document_frequency",
    f"with {CORPUS} select token, count(*) as df from (select unnest(list_distinct(tokens)) as token from corpus) group by 1",
)
def a13_df(t):
    return phrases.document_frequency(corpus(t))


@query("a13_filter_frequency", f"with {CORPUS}, {filter_sql('corpus', 'kept', 10, 0.5)} select org_id, array_to_string(tokens, ' ') as tokens from kept")
def a13(t):
    return joined(phrases.filter_frequency(corpus(t), 10, 0.5))


@query("a13_keep_n", f"with {CORPUS}, {filter_sql('corpus', 'kept', 2, 0.9, 500)} select token, df from kept_keep")
def a13_keep(t):
    return phrases.kept_tokens(corpus(t), 2, 0.9, keep_n=500)


@query("a14_unigram_counts", f"with {CORPUS}, {phrase_sql('corpus', 'ph')} select token, n from ph_u")
def a14_unigrams(t):
    return phrases.unigram_counts(corpus(t))


@query("a14_bigram_counts", f"with {CORPUS}, {phrase_sql('corpus', 'ph')} select first, second, n from ph_b")
def a14_bigrams(t):
    return phrases.bigram_counts(corpus(t))


@query("a14_total_tokens", f"with {CORPUS}, {phrase_sql('corpus', 'ph')} select total::bigint as total from ph_n")
def a14_total(t):
    return phrases.total_tokens(corpus(t))


@query(
    "t1_accepted_phrases",
    f"with {CORPUS}, {phrase_sql('corpus', 'ph')} select first, second, n, npmi from ph_a where npmi > 0.25",
)
def t1_accepted(t):
    return phrases.accepted_phrases(corpus(t))


@query("t1_detect_phrases", f"with {CORPUS}, {phrase_sql('corpus', 'ph')} select org_id, array_to_string(tokens, ' ') as tokens from ph")
def t1(t):
    return joined(phrases.detect_phrases(corpus(t)))


@query(
    "t2_ngrams",
    f"with {CORPUS}, {phrase_sql('corpus', 'p2')}, {phrase_sql('p2', 'p3')} select org_id, array_to_string(tokens, ' ') as tokens from p3",
)
def t2(t):
    return joined(phrases.ngrams(corpus(t), 3))


FULL = f"""{CORPUS}, {filter_sql('corpus', 'c1', 10, 1.0)}, {phrase_sql('c1', 'c2')},
{useful_sql('c2', 'c3')}, {filter_sql('c3', 'c4', 10, 0.9)}"""


@query("t3_description_tokens", f"with {FULL} select org_id, array_to_string(tokens, ' ') as tokens from c4")
def t3(t):
    return joined(description_tokens(described(t)))


@query("s14_description_tokens_of", f"with {FULL} select org_id, array_to_string(tokens, ' ') as tokens from c4")
def s14_tokens(t):
    path = scratch_path(t.spark, "tokens")
    store.save_table(ngram_tokens(corpus(t)), path)
    return joined(store.description_tokens_of(store.load_table(t.spark, path)))
