"""Queries of the corpus operators over the test tables, and SQL where it can say the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from sectorlens.llm import bpe, fingerprints, jaccard, language, lines, neardup, packing, quality, repair, rules, search, secrets, urls

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, table: str, sql: str | None = None):
    """Register a function of one whole table under ``name``."""

    def register(fn: Callable[[DataFrame], DataFrame]):
        QUERIES[name] = lambda spark, directory: fn(spark.read.parquet(f"{directory}/{table}.parquet"))
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return register


def _secrets_sql() -> str:
    """Places of matches from the lengths of the matches and of the text between them."""

    def written(rule: secrets.Rule) -> str:
        if not rule.ignore_case:
            return rule.pattern
        head, tail = rule.pattern.split(")", 1)
        return "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in head) + ")" + tail

    kinds = ", ".join(
        f"({i}, '{r.kind}', '{written(r).replace(chr(39), chr(39) * 2)}', {r.group}, {r.least})"
        for i, r in enumerate(secrets.RULES)
    )
    found = " union all ".join(
        f"""select doc_id, {i} as k, '{r.kind}' as kind, {r.least} as least,
        regexp_extract_all(t, p) as hits, regexp_extract_all(t, p, {r.group}) as parts, regexp_split_to_array(t, p) as gaps
        from (select doc_id, coalesce(text, '') as t, (select pattern from kinds where k = {i}) as p from documents)""".replace(
            "t, p", "t, '" + written(r).replace("'", "''") + "'"
        )
        for i, r in enumerate(secrets.RULES)
    )
    base = len(secrets.BASE_RULES)
    return f"""with kinds(k, kind, pattern, grp, least) as (values {kinds}),
    found as ({found}),
    each_hit as (select *, unnest(range(1, len(hits) + 1)) as i from found),
    spans as (
        select doc_id, k, kind, s, s + length(hits[i]) as e from (
            select *, list_sum(list_transform(gaps[1:i], lambda x: length(x)))
                + coalesce(list_sum(list_transform(hits[1:i - 1], lambda x: length(x))), 0) as s from each_hit)
        where length(parts[i]) >= least),
    joined as (
        select doc_id, count(*) filter (k = 0) as n_assign, count(*) filter (k = 1) as n_access,
            count(*) filter (k = 2) as n_hex,
            string_agg(kind || ':' || s::bigint || ':' || e::bigint, ',' order by s, k) filter (k < {base}) as base,
            string_agg(kind || ':' || s::bigint || ':' || e::bigint, ',' order by s, k) as spans
        from spans group by doc_id)
    select doc_id, coalesce(n_assign, 0) as n_assign, coalesce(n_access, 0) as n_access, coalesce(n_hex, 0) as n_hex,
        sha256(coalesce(base, '')) as base_sha256, coalesce(spans, '') as spans
    from documents left join joined using (doc_id)"""


@query("op1_secret_scan", "documents", _secrets_sql())
def op1(documents: DataFrame) -> DataFrame:
    return secrets.digest(documents)


@query("op3_bpe", "documents")
def op3(documents: DataFrame) -> DataFrame:
    return bpe.round_trip(documents)


@query("op9_packing", "documents")
def op9(documents: DataFrame) -> DataFrame:
    return packing.pack(documents)


# Who reaches whom over links, and the smallest of these; {nodes} are all nodes, {links} their pairs.
REACHED = """both_ways as (select x, y from {links} union all select y, x from {links}),
    reach(node, root) as (select node, node from {nodes} union select b.y, r.root from reach r join both_ways b on b.x = r.node),
    component as (select node, min(root) as component_id from reach group by node)"""

JACCARD_SQL = f"""with recursive words as (
      select doc_id, regexp_extract_all(translate(coalesce(text, ''), '{urls.UPPER}', '{urls.LOWER}'), '[^\\x20\\x09-\\x0D]+') as w from documents),
    shingles as (
      select doc_id, case when len(w) >= 5 then list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')))
        when len(w) > 0 then [array_to_string(w, ' ')] else [] end as s from words),
    nodes as (select doc_id as node, len(s) as n from shingles),
    each as (select doc_id, unnest(s) as s from shingles),
    common as (select a.doc_id as x, b.doc_id as y, count(*) as k from each a join each b on a.s = b.s and a.doc_id < b.doc_id group by all),
    links as (
      select x, y from common join nodes p on p.node = x join nodes q on q.node = y where 100 * k >= {jaccard.PERCENT} * (p.n + q.n - k)),
    {REACHED.format(links="links", nodes="nodes")}
    select node as doc_id, n::bigint as n_shingles, component_id from nodes join component using (node)"""


@query("op4_jaccard_join", "documents", JACCARD_SQL)
def op4(documents: DataFrame) -> DataFrame:
    return jaccard.jaccard_components(documents)


NEAR_SQL = f"""with recursive nodes as (select vec_id as node, embedding::double[] as v from embeddings),
    usable as (
      select *, sqrt(list_dot_product(v, v)) as norm from nodes
      where v is not null and not list_contains(list_transform(v, lambda e: e is null or not isfinite(e)), true) and list_dot_product(v, v) > 0),
    links as (
      select a.node as x, b.node as y from usable a join usable b on a.node < b.node and len(a.v) = len(b.v)
      where list_dot_product(a.v, b.v) / (a.norm * b.norm) >= {neardup.COSINE}),
    {REACHED.format(links="links", nodes="nodes")},
    counts as (select x as node, count(*) as n_links from both_ways group by x)
    select node as vec_id, coalesce(n_links, 0) as n_links, component_id, node = component_id as kept
    from nodes join component using (node) left join counts using (node)"""


@query("op7_near_vectors", "embeddings", NEAR_SQL)
def op7(embeddings: DataFrame) -> DataFrame:
    return neardup.near_vectors(embeddings)


@query("op2_fingerprints", "documents")
def op2(documents: DataFrame) -> DataFrame:
    return fingerprints.fingerprints(documents)


@query("op6_language", "documents")
def op6(documents: DataFrame) -> DataFrame:
    return language.predict_documents(documents)


@query("op5_line_dedup", "documents")
def op5(documents: DataFrame) -> DataFrame:
    kept = lines.drop_recurring(documents, n_lines="n_lines", n_dropped="n_dropped")
    return kept.select("doc_id", "n_lines", "n_dropped", "text")


@query("op8_url_filter", "pages")
def op8(pages: DataFrame) -> DataFrame:
    return urls.judge(pages)


def op10(spark: SparkSession, directory: str) -> DataFrame:
    documents, labels = (spark.read.parquet(f"{directory}/{t}.parquet") for t in ("documents", "labels"))
    return quality.grade_documents(documents, labels)


QUERIES["op10_quality"] = op10


SEARCH_SQL = f"""with tokens as (
      select doc_id, unnest(regexp_extract_all(translate(text, '{urls.UPPER}', '{urls.LOWER}'), '{search.TERM}')) as term from documents),
    counts as (select doc_id, term, count(*) as tf from tokens group by all),
    lengths as (select doc_id, sum(tf)::bigint as n from counts group by all),
    totals as (select count(*) as docs, sum(n)::bigint as terms from lengths),
    asked as (
      select item_id, term, count(*) as times
      from (select item_id, unnest(regexp_extract_all(translate(text, '{urls.UPPER}', '{urls.LOWER}'), '{search.TERM}')) as term from benchmark)
      group by all),
    weights as (
      select term, floor(1000 * ln((2 * any_value(docs) + 2)::double / (2 * count(*) + 1)::double))::bigint as w
      from counts, totals group by term),
    scores as (
      select item_id, doc_id, sum(times * w * ((1000000000 * tf) // (1000 * tf + 12 * (75 + (25 * n * docs) // terms))))::bigint as score
      from asked join counts using (term) join weights using (term) join lengths using (doc_id), totals group by all)
    select item_id, (row_number() over (partition by item_id order by score desc, doc_id))::int as rank, doc_id, score
    from scores where score > 0 qualify rank <= {search.BEST}"""


def op11(spark: SparkSession, directory: str) -> DataFrame:
    documents, items = (spark.read.parquet(f"{directory}/{t}.parquet") for t in ("documents", "benchmark"))
    return search.search(documents, items)


QUERIES["op11_ranked_search"], ORACLES["op11_ranked_search"] = op11, SEARCH_SQL


RULES_SQL = f"""with texts as (
      select doc_id, source, coalesce(text, '') as text, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') as w from documents),
    windows as (
      select doc_id, i, array_to_string(w[i:i + {rules.WINDOW - 1}], ' ') as g
      from (select doc_id, w, unnest(range(1, len(w) - {rules.WINDOW - 2})) as i from texts)),
    twice as (select doc_id, i from windows qualify count(*) over (partition by doc_id, g) > 1),
    repeated as (
      select doc_id, count(distinct i + j)::bigint as n_repeat_words
      from twice, (select unnest(range({rules.WINDOW})) as j) group by doc_id),
    each as (
      select doc_id, source, text, line, regexp_extract_all(line, '[^\\x20\\x09-\\x0D]+') as lw
      from (select doc_id, source, text, unnest(string_split(text, chr(10))) as line from texts)),
    worded as (
      select *, translate(array_to_string(lw, ' '), '{urls.UPPER}', '{urls.LOWER}') as normal from each where len(lw) > 0),
    dups as (select doc_id, (count(*) - count(distinct line))::bigint as n_dup_lines from worded group by doc_id),
    frequent as (select source, normal from worded group by all having count(distinct text) > {rules.LINE_LIMIT}),
    gone as (
      select doc_id, sum(len(lw))::bigint as n from worded w join frequent f on f.source is not distinct from w.source and f.normal = w.normal
      group by doc_id),
    judged as (
      select doc_id, len(w)::bigint as n_words, length(array_to_string(w, ''))::bigint as word_chars,
        length(regexp_replace(text, '[^#*$%&|<>]', '', 'g'))::bigint as n_symbols,
        coalesce(n_dup_lines, 0) as n_dup_lines, coalesce(n_repeat_words, 0) as n_repeat_words, len(w)::bigint - coalesce(gone.n, 0) as n_words_left
      from texts left join dups using (doc_id) left join repeated using (doc_id) left join gone using (doc_id))
    select *, n_words < {rules.LEAST_WORDS} or 100 * n_repeat_words > {rules.MOST_REPEATED} * n_words as base_failed,
      not (n_words < {rules.LEAST_WORDS} or 100 * n_repeat_words > {rules.MOST_REPEATED} * n_words)
        and n_words_left >= {rules.LEAST_WORDS} and 100 * n_words_left >= {rules.LEAST_LEFT} * n_words as kept
    from judged"""


@query("op13_quality_rules", "documents", RULES_SQL)
def op13(documents: DataFrame) -> DataFrame:
    return rules.quality_rules(documents)


# Repair by exact recursion over a conversation's rows: the best (cost, audit) of each role before a row.
UNREACHED = "{'c': 1000000, 'a': ''}"
STATE = ("n", "s", "u", "a")  # nothing yet, or the last role


def _best_sql(*options: str) -> str:
    return f"list_min([{', '.join(options)}])"


def _step_sql(state: str, cost: str, edit: str) -> str:
    return f"struct_pack(c := {state}.c + {cost}, a := {state}.a || '{edit}')"


def _inserted_sql(source: str) -> str:
    """The states after at most one more insertion each."""
    into = {"u": ("n", "s", "a"), "a": ("u",)}
    return ", ".join(
        f"{_best_sql(q, *[_step_sql(p, '2', 'I') for p in into.get(q, ())])} as {q}" for q in STATE
    ).join(("select conv, i, ", f" from {source}"))


def _row_sql() -> str:
    """The states after a row: deleted, or, where it may stay, kept or with another role."""
    stays, late = "r.fault not in ('blank', 'duplicate')", "(r.fault = 'truncated')::int"
    keeps = {"s": ("n",), "u": ("n", "s", "a"), "a": ("u",)}
    cells = []
    for q in STATE:
        options = [_step_sql(f"m.{q}", "3", "D")]
        for p in keeps.get(q, ()):
            kept = f"case when {stays} and r.letter = '{q}' then {_step_sql('m.' + p, late, 'K')} else {UNREACHED} end"
            changed = f"case when {stays} then {_step_sql('m.' + p, '2 + ' + late, 'R')} else {UNREACHED} end"
            options += [kept] if q == "s" else [kept, changed]
        cells.append(f"{_best_sql(*options)} as {q}")
    return f"select m.conv, m.i + 1 as i, {', '.join(cells)} from m join faults r on r.conv = m.conv and r.i = m.i + 1"


REPAIR_SQL = f"""with recursive bits as (select list_transform(range(256), lambda b: list_reduce(list_prepend(b::bigint, range(8)),
        lambda x, k: case when x % 2 = 1 then xor(x // 2, 3988292384) else x // 2 end)) as crc),
    named as (select *, coalesce(conv_id::varchar, ' ') || ':' || coalesce(turn::varchar, ' ') as place from conversations),
    coded as (
      select named.*, xor(list_reduce(list_prepend(4294967295, list_transform(range(1, length(place) + 1), lambda j: ascii(substr(place, j, 1))::bigint)),
        lambda x, b: xor(x // 256, crc[xor(x % 256, b) + 1])), 4294967295) % 20 as code
      from named, bits),
    damaged as (
      select conv_id, coalesce(conv_id::varchar, 'null') as conv, turn, case when code = 4 then 'user' else coalesce(role, ' ') end as role,
        case when code = 1 then '' when code = 2 then regexp_replace(coalesce(text, ' '), '[.!?]', '', 'g') else coalesce(text, ' ') end as text,
        unnest(range(case when code = 3 then 2 else 1 end)) as copy
      from coded where code <> 0),
    numbered as (
      select *, row_number() over (partition by conv order by turn nulls first, role, md5(md5(role) || text), copy) as i,
        row_number() over (partition by conv, role, text order by turn nulls first, copy) as nth from damaged),
    faults as (
      select *, left(role, 1) as letter, lead(left(role, 1)) over (partition by conv order by i) as following,
        case when not regexp_matches(text, '[^\\x20\\x09-\\x0D]') then 'blank' when nth > 1 then 'duplicate'
          when not regexp_matches(text, '[.!?][\\x20\\x09-\\x0D]*$') then 'truncated' else 'none' end as fault
      from numbered),
    m(conv, i, n, s, u, a) as (
      select conv, 0::bigint, struct_pack(c := 0, a := ''), struct_pack(c := 1000000, a := ''), struct_pack(c := 2, a := 'I'), struct_pack(c := 4, a := 'II')
      from (select distinct conv from faults)
      union all select conv, i, n, s, u, a from ({_inserted_sql(f"({_inserted_sql(f'({_row_sql()})')})")})),
    last as (select conv, max(i) as i from m group by conv),
    chosen as (select conv, {_best_sql("n", "a")} as best from m join last using (conv, i)),
    edits as (
      select conv, best.a as audit, j, substr(best.a, j, 1) as e, len(regexp_replace(substr(best.a, 1, j), 'I', '', 'g')) as i,
        sum((substr(best.a, j, 1) <> 'D')::int) over (partition by conv order by j) as place
      from (select *, unnest(range(1, length(best.a) + 1)) as j from chosen)),
    placed as (
      select e.*, f.role, f.text, first_value(e.e = 'K' and f.letter = 's') over (partition by e.conv, e.e = 'D' order by j) as led
      from edits e left join faults f on f.conv = e.conv and f.i = e.i),
    repaired as (
      select conv, string_agg(
          case when e = 'K' then role || ':' || text
            else case when (place - led::int) % 2 = 1 then 'user' else 'assistant' end || ':' || case when e = 'I' then '' else text end end,
          chr(10) order by j) as body
      from placed where e <> 'D' group by conv),
    counted as (
      select conv, coalesce(max(turn) - min(turn) + 1 - count(distinct turn), 0) as gaps, count(*) filter (fault = 'blank') as blank,
        count(*) filter (fault = 'duplicate') as duplicate, count(*) filter (fault = 'truncated') as truncated,
        count(*) filter (letter || following not in ('su', 'ua', 'au')) as illegal
      from faults group by conv)
    select o.conv_id, coalesce(gaps, 0) as gaps, coalesce(blank, 0) as blank, coalesce(duplicate, 0) as duplicate,
      coalesce(truncated, 0) as truncated, coalesce(illegal, 0) as illegal, coalesce(best.c, 0)::bigint as cost,
      coalesce(best.a, '') as audit, sha256(coalesce(body, '')) as repaired_sha256
    from (select distinct conv_id, coalesce(conv_id::varchar, 'null') as conv from conversations) o
    left join counted using (conv) left join chosen using (conv) left join repaired using (conv)"""


@query("op12_conversation_repair", "conversations", REPAIR_SQL)
def op12(conversations: DataFrame) -> DataFrame:
    return repair.repair_damaged(conversations)
