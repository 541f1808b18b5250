"""The queries in DuckDB SQL."""

from __future__ import annotations

from .functions import fixed_values as V
from .functions.text import COMMON_ENTITIES
from .queries import EXPANDED, PATHS, PLANNED, QUESTIONS, RETRIEVAL


def q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def lst(xs) -> str:
    return "[" + ", ".join(map(q, xs)) + "]"


def values(texts: list[str]) -> str:
    return "(select unnest(range(" + str(len(texts)) + ")) as query_id, unnest(" + lst(texts) + ") as query)"


WS = "(' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13))"


def strip(x: str) -> str:
    return f"trim({x}, {WS})"


def ascii_lower(x: str) -> str:
    return rf"lower(regexp_replace(coalesce({x}, ''), '[^\x00-\x7F]', '', 'g'))"


def tokens(x: str, pattern: str, stop: list[str]) -> str:
    return f"list_filter(regexp_extract_all({x}, '{pattern}'), lambda t: not list_contains({lst(stop)}, t))"


def index_tokens(x: str) -> str:
    return tokens(f"lower({x})", r"[a-z0-9\x{00c0}-\x{024f}]{3,}", V.INDEX_STOP_WORDS)


def retrieval_tokens(norm: str) -> str:
    return tokens(norm, "[a-z0-9]{3,}", V.RETRIEVAL_STOP_WORDS)


def search_terms(norm: str) -> str:
    return tokens(norm, "[a-z0-9_-]{3,}", V.SEARCH_STOP_WORDS)


def turns_asked(questions: list[str]) -> str:
    return f"(select conv_id * 1000 + turn as query_id, {lst(questions)}[(conv_id + turn) % {len(questions)} + 1] || ' ' || left({ascii_lower('text')}, 60) as query from conversations where role = 'user')"


def any_of(x: str, needles) -> str:
    return "(" + " or ".join(f"contains({x}, {q(n)})" for n in needles) + ")"


def category(x: str, form: str = "jsonl") -> str:
    return "case " + " ".join(f"when {any_of(f'lower({x})', ns)} then '{c}'" for c, ns in V.CATEGORY_KEYWORDS[form].items()) + " else 'chat' end"


def importance(cat: str, x: str) -> str:
    return f"cast(case {cat} " + " ".join(f"when '{c}' then {v}" for c, v in V.IMPORTANCE.items()) + f" else 0.5 end + case when length({x}) > 1000 then 0.1 else 0.0 end as double)"


def occurrences(x: str, n: str) -> str:
    return f"cast((length({x}) - length(replace({x}, {n}, ''))) // length({n}) as bigint)"


def capped(x: str, terms: str, weight: float, cap: float) -> str:
    return f"list_sum(list_transform({terms}, lambda t: least(cast({weight} as double) * {occurrences(x, 't')}, cast({cap} as double))))"


def matched(x: str, terms: str) -> str:
    return f"list_filter({terms}, lambda t: contains({x}, t))"


def proximity(x: str, m: str) -> str:
    at = f"list_transform({m}, lambda t: strpos({x}, t))"
    return f"case when len({m}) < 2 then cast(0 as double) else greatest(cast(0 as double), 4.0 - (list_max({at}) - list_min({at})) / 220.0) end"


def code_penalty(x: str) -> str:
    return "least(cast(0.4 as double) * (" + " + ".join(occurrences(f"lower({x})", q(n)) for n in V.CODE_NEEDLES) + "), cast(4 as double))"


def least_matches(terms: str) -> str:
    return f"case when len({terms}) >= 4 then 3 when len({terms}) >= 2 then 2 else 1 end"


def labels(x: str, table: dict[str, list[str]]) -> str:
    cases = ", ".join(f"case when {any_of(f'lower({x})', ns)} then '{k}' end" for k, ns in table.items())
    return f"array_to_string(list_sort(list_filter([{cases}], lambda v: v is not null)), '|')"


def keywords(x: str) -> str:
    return f"array_to_string(list_slice(list_sort(list_distinct({tokens(f'lower({x})', '[a-z]{4,}', V.KEYWORD_STOP_WORDS)})), 1, 30), '|')"


def summary(x: str) -> str:
    code = " or ".join(f"starts_with(v, {q(s)})" for s in V.CODE_LINE_STARTS)
    lines = f"list_filter(list_transform(string_split({x}, chr(10)), lambda v: {strip('v')}), lambda v: v <> '' and not ({code}))"
    said = f"list_transform({lines}, lambda v: {strip("case when starts_with(v, 'assistant:') then substr(v, 11) when starts_with(v, 'user:') then substr(v, 6) else v end")})"
    return f"left(array_to_string(list_filter({said}, lambda v: length(v) > 20), chr(10)), 200)"


def signature(x: str) -> str:
    return f"list_distinct(list_filter(regexp_split_to_array(lower(left({x}, 200)), '\\s+'), lambda w: w <> ''))"


def jaccard(a: str, b: str) -> str:
    both = f"len(list_intersect({a}, {b}))"
    return f"case when len({a}) + len({b}) > 0 then {both} / cast(len({a}) + len({b}) - {both} as double) else 0.0 end"


RECORDS = f"""r as (select doc_id, source, lang, text, {category('text')} as category from documents),
    rec as (select *, {importance('category', 'text')} as importance from r)"""
DATED = "dated as (select d.*, e.ts as created_at from documents d join events e on e.event_id = d.doc_id)"
METRICS = """m as (select event_id as metric_id, ts, cast(user_id as varchar) as query, nullif(event_type, 'click') as strategy,
    event_id % 9 as bm25_candidates, event_id % 6 as final_count, value * 40 as elapsed_ms, (event_id % 50) / 10.0::double as top_score, user_id % 4 as sources_count from events)"""


def fixed_chunks(texts: str) -> str:
    """CTEs up to fixed(doc_id, chunk_index, piece, ...): slices of texts(doc_id, text)."""
    return f"""fx as (select d.*, s as pos, {strip('substr(text, cast(s as bigint) + 1, 512)')} as piece, least(s + 512, length(text)) as stop
      from ({texts}) d, unnest(range(0, greatest(length(text), 1), 512)) as u(s) where length({strip('text')}) >= 50),
    fixed as (select *, row_number() over (partition by doc_id order by pos) - 1 as chunk_index from fx where length(piece) >= 50 or length(text) <= 512)"""


FIXED = fixed_chunks("select * from documents")
POSTINGS = f"""tok as (select doc_id, {index_tokens('text')} as ts from documents),
    post as (select term, doc_id, dl, count(*) as tf from (select doc_id, len(ts) as dl, unnest(ts) as term from tok) group by all),
    st as (select count(*) as n, avg(len(ts)) as avgdl from tok),
    idf as (select term, count(*) as df, ln((n - count(*) + 0.5) / (count(*) + 0.5) + 1) as idf from post, st group by term, n)"""
EXPAND_INDEX = "query || case " + " ".join(f"when contains(lower(query), '{k}') then ' {' '.join(v[:3])}'" for k, v in V.INDEX_EXPANSIONS.items()) + " else '' end"
BM25 = POSTINGS + f""",
    qs as (select query_id, query, {index_tokens('query')} as own, {index_tokens(EXPAND_INDEX)} as every from {values(RETRIEVAL)}),
    qt as (select query_id, term, count(*) as times, any_value(len(list_filter(own, lambda x: x = term))) as bonus from (select query_id, own, unnest(every) as term from qs) group by query_id, term),
    sc as (select query_id, doc_id, sum(times * idf * tf * 2.5 / (tf + 1.5 * (1 - 0.75 + 0.75 * dl / avgdl)) + 2.0 * bonus) as score from post join idf using (term) join qt using (term), st group by all)"""


def packed(parts: str, sep: str, least: int = 50) -> str:
    """Greedy packing of parts(doc_id, i, part, sep, n), as a recursive walk over documents side by side."""
    return f"""parts as materialized ({parts}),
    walk(doc_id, i, cur, flushed) as (
      select doc_id, i, part, cast(null as varchar) from parts where i = 1
      union all
      select w.doc_id, p.i, case when length(case when w.cur = '' then p.part else w.cur || {sep} || p.part end) <= 512 then case when w.cur = '' then p.part else w.cur || {sep} || p.part end else p.part end,
             case when length(case when w.cur = '' then p.part else w.cur || {sep} || p.part end) <= 512 then null else w.cur end
      from walk w join parts p on p.doc_id = w.doc_id and p.i = w.i + 1),
    pieces as (select doc_id, i * 2 as o, {strip('flushed')} as t from walk where flushed is not null
      union all select w.doc_id, w.i * 2 + 1, {strip('cur')} from walk w join (select doc_id, max(i) as i from parts group by doc_id) l using (doc_id, i)),
    good as (select doc_id, o, t from pieces where length(t) >= {least})"""


def planner_scores(x: str) -> str:
    return ", ".join(f"cast(0.3 as double) * ({' + '.join(f'len(regexp_extract_all(lower({x}), {q(p)}))' for p in ps)}) as s_{t}" for t, ps in V.QUERY_PATTERNS.items())


OTHERS = [t for t in V.QUERY_PATTERNS if t != "personal"]
PLANNER = f"""s as (select query_id, query, {planner_scores('query')} from {turns_asked(QUESTIONS)}),
    o as (select *, greatest({', '.join(f's_{t}' for t in OTHERS)}) as other from s),
    p as (select *, s_personal > other and not (other >= s_personal * 0.7 and other > 0) as personal from o),
    c as (select query_id, query, case when greatest(other, s_personal) < 0.1 then 'exploratory' when personal then 'personal' {' '.join(f"when s_{t} = other then '{t}'" for t in OTHERS)} end as query_type,
      cast(case when greatest(other, s_personal) < 0.1 then 0.3 when personal then least(s_personal, 1.0) else least(other, 1.0) end as double) as confidence from p)"""

SUFFIX = r"lower(regexp_extract(path, '(\.[^./\\]+)$', 1))"
TITLES = f"list_filter(list_transform(list_filter(list_slice(ls, 1, 10), lambda x: starts_with(x, 'Title:') or starts_with(x, '# ')), lambda x: {strip('regexp_replace(regexp_replace(x, ' + q('^[^:]*:') + ', ' + q('') + '), ' + q('^[^#]*#') + ', ' + q('') + ')')}), lambda x: length(x) > 5 and length(x) < 100)"
SPOKEN = r"list_filter(list_transform(list_filter(list_slice(ls, 1, 5), lambda x: length(x) > 20 and length(x) < 100), lambda x: regexp_replace(x, '^(?:User:|Assistant:|System:|Human:|AI:)\s*', '')), lambda x: length(x) > 20)"
FIRST_WORDS = r"array_to_string(list_slice(list_filter(regexp_split_to_array(text, '\s+'), lambda w: w <> ''), 1, 15), ' ')"
FILES = r"list_concat(regexp_extract_all(x, '[/\\][\w\-\.]+(?:/[\w\-\.]+){1,5}'), regexp_extract_all(x, '[\w\-]+\.(?:%s)'))" % "|".join(V.FILE_EXTENSIONS)
HTML = r"""regexp_replace(regexp_replace(regexp_replace(html, '(?is)<script.*?>.*?</script>|<style.*?>.*?</style>', ' ', 'g'), '(?i)<br\s*/?>|</p>|</div>|</li>|</tr>|</h[1-6]>', chr(10), 'g'), '(?s)<[^>]+>', ' ', 'g')"""
for _e, _c in COMMON_ENTITIES.items():  # these names, but for apos, count without their semicolon too, as where a title is cut
    HTML = f"replace({HTML}, {q(f'&{_e};')}, {q(_c)})" if _e in ("#39", "apos") else f"regexp_replace({HTML}, {q(f'&{_e};?')}, {q(_c)}, 'g')"
KEYWORD_TERMS = lst(["tion", "thon", "license"])
CTX = "'[' || rank || '] ' || coalesce(nullif(source, ''), 'unknown') || ': ' || left(text, 500)"
LISTED = "l as (select doc_id // 40 as query_id, doc_id % 40 as rank, doc_id, text from documents)"

WIDE = ", ".join(f"when '{k}' then {lst(v[:2])}" for k, v in V.RETRIEVAL_EXPANSIONS.items()).replace(", when", " when")


def recursive_chunks(texts: str) -> str:
    """CTEs up to every(doc_id, o, t): structure-aware chunks of texts(doc_id, text)."""
    seps = " ".join(f"when contains(text, {x}) then {x}" for x in ("chr(10) || chr(10)", "chr(10)", q(". "), q("。"), q("! "), q("? "), q("; "), q(" ")))
    cut = strip("substr(text, cast(x as bigint) + 1, 512)")
    return f"""s as (select doc_id, text, case {seps} end as sep from ({texts}) where length({strip('text')}) >= 50),
        {packed("select doc_id, unnest(range(1, len(ps) + 1)) as i, unnest(ps) as part, sep from (select doc_id, sep, string_split(text, sep) as ps from s where length(text) > 512 and sep is not null)", 'p.sep')},
        every as (select doc_id, o, t from good union all select doc_id, 0, {strip('text')} from s where length(text) <= 512
          union all select doc_id, x, {cut} from s, unnest(range(0, length(text), 512)) as u(x) where length(text) > 512 and sep is null and length({cut}) >= 50)"""


def window_end(start: str) -> str:
    """Where a sliding window that begins at start ends."""
    stop = f"least({start} + 512, n)"
    part = f"substr(text, {start} + 410, {stop} - {start} - 409)"
    found = " ".join(f"when strpos(reverse({part}), reverse({b})) > 0 and length({part}) - strpos(reverse({part}), reverse({b})) - length({b}) + 1 > 0 then {start} + 409 + length({part}) - strpos(reverse({part}), reverse({b})) + 1" for b in ("chr(10) || chr(10)", q(". "), q("。"), "chr(10)", q("! "), q("? ")))
    return f"case when {start} + 512 >= n then n {found} else {stop} end"


def greedy(rows: str, name: str = "kept") -> str:
    """CTEs up to kept(query_id, rank): of rows(query_id, rank from 1, text) those not too similar to one kept before."""
    return f"""{name}_w as materialized (select *, {signature('text')} as w from {rows}),
        {name}_bad as materialized (select x.query_id, x.rank as first, y.rank as second from {name}_w x join {name}_w y on x.query_id = y.query_id and x.rank < y.rank where {jaccard('x.w', 'y.w')} > 0.8),
        {name}_walk as (select query_id, 0::bigint as rank, []::bigint[] as kept, max(rank) as last from {name}_w group by query_id
          union all select k.query_id, k.rank + 1, case when exists (select 1 from {name}_bad b where b.query_id = k.query_id and b.second = k.rank + 1 and list_contains(k.kept, b.first)) then k.kept else list_append(k.kept, k.rank + 1) end, k.last from {name}_walk k where k.rank < k.last),
        {name} as (select query_id, unnest(kept) as rank from {name}_walk where rank = last)"""


SLIDING = f"""with recursive d as (select doc_id, text, length(text) as n from documents where length({strip('text')}) >= 50),
        walk as (select doc_id, cast(0 as bigint) as start, cast({window_end('0')} as bigint) as stop from d
          union all select doc_id, b, cast({window_end('b')} as bigint) from (select w.doc_id, greatest(w.stop - 64, w.start + 1) as b, text, n from walk w join d using (doc_id) where w.stop < n)),
        p as (select doc_id, start, stop, n, {strip('substr(text, start + 1, stop - start)')} as t from walk join d using (doc_id))"""


def semantic_chunks(texts: str) -> str:
    """CTEs up to good(doc_id, o, t): packed paragraphs of texts(doc_id, text)."""
    return f"""s as (select doc_id, list_filter(list_transform(regexp_split_to_array(text, '\\n\\s*\\n'), lambda x: {strip('x')}), lambda x: x <> '') as ps from ({texts}) where length({strip('text')}) >= 50),
        {packed("select doc_id, unnest(range(1, len(ps) + 1)) as i, unnest(ps) as part from s", 'chr(10) || chr(10)')}"""


SEMANTIC = "with recursive " + semantic_chunks("select doc_id, replace(text, chr(10), chr(10) || chr(10)) as text from documents")


def strategy_of(text: str, source: str) -> str:
    return rf"""case when {source} in ({', '.join(map(q, V.CONVERSATIONAL_SOURCES))}) and regexp_matches(left({text}, 500), '(?i)(user|assistant|human|ai):\s') and len(regexp_extract_all({text}, '(?i)(?:^|\n)(user|assistant|human|ai):\s')) >= 2 then 'conversation'
        when len(regexp_extract_all({text}, '(?m)^#{{1,6}}\s')) >= 3 then 'semantic' when len(regexp_extract_all({text}, '```')) >= 4 or {source} = 'code' then 'fixed' else 'recursive' end"""


def html_text(html: str) -> str:
    return rf"array_to_string(list_filter(list_transform(regexp_split_to_array({HTML.replace('(html,', f'({html},')}, '\r\n|\r|\n'), lambda x: trim(regexp_replace(x, '[\s]+', ' ', 'g'))), lambda x: length(x) >= 2), chr(10))"


ORACLES: dict[str, str] = {
    "expand_queries": f"""select query_id, {EXPAND_INDEX} as index_query, array_to_string(list_concat(ts, flatten(list_transform(ts, lambda t: case t {WIDE} else [] end))), ' ') as retrieval_terms
        from (select *, {retrieval_tokens(ascii_lower('query'))} as ts from {turns_asked([*QUESTIONS, *EXPANDED])})""",
    "rerank_hook": f"""with l as (select doc_id // 40 as query_id, doc_id % 40 as rank, doc_id, text from documents),
        j as (select *, {signature("'the of and tion'")} as a, {signature('text').replace('200', '2000')} as b from l), r as (select query_id, doc_id, rank, {jaccard('a', 'b')} as rerank from j),
        k as (select query_id, row_number() over (partition by query_id order by round(rerank, 9) desc, rank) as rank, doc_id, rerank from r) select query_id, rank, doc_id, round(rerank, 6) as rerank from k where rank <= 10""",
    "chunk_sliding": f"{SLIDING} select doc_id, row_number() over (partition by doc_id order by start) - 1 as chunk_index, start as start_char, stop as end_char, sha256(t) as chunk_hash from p where length(t) >= 50",
    "chunk_dispatch": f"""
        select doc_id, row_number() over (partition by doc_id order by start) - 1 as chunk_index, 'sliding' as strategy, case when n <= 512 then '{{}}' else '{{"size": ' || length(t) || ', "overlap": 64}}' end as metadata, sha256(t) as chunk_hash
          from ({SLIDING} select doc_id, start, t, n from p where length(t) >= 50 and doc_id % 5 in (1, 4))
        union all select doc_id, chunk_index, 'fixed', case when n <= 512 then '{{}}' else '{{"size": ' || length(piece) || '}}' end, sha256(piece) from (with {FIXED} select doc_id, chunk_index, piece, length(text) as n from fixed where doc_id % 5 = 0)
        union all select doc_id, row_number() over (partition by doc_id order by o) - 1, 'recursive', case when strpos(whole, ' ') = 0 and strpos(whole, chr(10)) = 0 and length(whole) > 512 then '{{"fallback": "character_split"}}' else '{{}}' end, sha256(t)
          from (with recursive {recursive_chunks("select doc_id, text from documents where doc_id % 5 = 2")} select every.*, d.text as whole from every join documents d using (doc_id))
        union all select doc_id, row_number() over (partition by doc_id order by o) - 1, 'semantic', '{{"paragraph_count": ' || (length(t) - length(replace(t, chr(10) || chr(10), ''))) // 2 + 1 || '}}', sha256(t) from ({SEMANTIC} select * from good where doc_id % 5 = 3)""",
    "auto_chunk": f"""with recursive {recursive_chunks("select doc_id, text from documents where doc_id % 4 <> 1")},
        f as (select doc_id, '```' || chr(10) || '```' || chr(10) || '```' || chr(10) || '```' || text as t from documents where doc_id % 4 = 1),
        fx as (select doc_id, t, s, {strip('substr(t, cast(s as bigint) + 1, 512)')} as piece from f, unnest(range(0, length(t), 512)) as u(s) where length({strip('t')}) >= 50)
        select doc_id, row_number() over (partition by doc_id order by o) - 1 as chunk_index, 'recursive' as strategy, sha256(t) as chunk_hash from every
        union all select doc_id, row_number() over (partition by doc_id order by s) - 1, 'fixed', sha256(piece) from fx where length(piece) >= 50 or length(t) <= 512""",
    "manifest_upsert": """with d as (select cast(doc_id as varchar) as path, sha256(text) as hash, doc_id from documents),
        o as (select path, case when doc_id % 5 = 0 then 'stale' else hash end as hash from d where doc_id % 3 <> 0), n as (select path, hash from d where doc_id % 7 <> 0)
        select coalesce(n.path, o.path) as path, coalesce(n.hash, o.hash) as hash, case when o.hash is null or coalesce(n.hash, o.hash) <> o.hash then 'pending' else 'ingested' end as status from n full join o on n.path = o.path""",
    "classify_sources": f"""with p as (select page_id, url || '/' || {lst(PATHS)}[page_id % {len(PATHS)} + 1] as path from pages), s as (select page_id, path, {SUFFIX} as suffix, lower(regexp_extract(path, '([^/\\\\]+)$', 1)) as name, lower(path) as low from p)
        select page_id, path, suffix, case suffix {' '.join(f"when '{k}' then '{v[0]}'" for k, v in V.FILE_TYPES.items())} else 'unknown' end as file_type,
        case when suffix = '.zip' and contains(name, 'takeout') then 'takeout_extractor' else case suffix {' '.join(f"when '{k}' then '{v[1]}'" for k, v in V.FILE_TYPES.items())} else 'none' end end as extractor,
        suffix in ({', '.join(q(k) for k, v in V.FILE_TYPES.items() if v[2])}) as processable,
        suffix in ('.html', '.json', '.md', '.txt') and (regexp_matches(low, 'conversation|chat|dialogue|assistant|aplicaciones de gemini') or (contains(low, 'gemini') and suffix in ('.html', '.json', '.txt')) or ends_with(low, 'miactividad.html')) as takeout_text from s""",
    "records_projection": f"with {RECORDS} select doc_id, source, category, round(importance, 6) as importance, left(text, 2000) as preview, sha256(text) as hash from rec",
    "category_variants": "select page_id, " + ", ".join(f"{category('html', f)} as {f}" for f in V.CATEGORY_KEYWORDS) + " from pages",
    "timestamp_formats": """select event_id, case event_id % 4 when 0 then strftime(make_timestamp_ms(1700000000000 + event_id * 1000), '%Y-%m-%dT%H:%M:%S') when 1 then strftime(ts, '%Y-%m-%dT%H:%M:%S') end as iso,
        case event_id % 4 when 0 then strftime(make_timestamp_ms(1700000000000 + event_id * 1000), '%Y-%m-%d') when 1 then strftime(ts, '%Y-%m-%d') else 'unknown' end as shown from events""",
    "jsonl_tolerant_read": f"""with m as (select conv_id, turn, {strip('text')} as t from conversations where {strip('text')} <> ''), g as (select conv_id, count(*) as n, string_agg(t, ' ' order by turn) as b from m group by conv_id)
        select 'c' || conv_id as external_id, 'talk ' || conv_id as title, '2024-01-05T00:00:00' as created_at, {category('b')} as category, n as n_messages, sha256(b) as hash from g""",
    "event_log_sessions": f"""with m as (select * from conversations where {strip('text')} <> ''), g as (select conv_id, count(*) as n, string_agg(text, ' ' order by turn) as b, string_agg(role || ': ' || text, chr(10) || chr(10) order by turn) as c, arg_min(text, turn) filter (role = 'user') as u from m group by conv_id)
        select cast(conv_id as varchar) as external_id, coalesce(nullif({strip('left(u, 100)')}, ''), cast(conv_id as varchar)) as title, {category('b', 'factory')} as category, n as n_messages, sha256(c) as hash from g""",
    "qwen_sessions": f"""with m as (select conv_id, turn, {strip('text')} as t from conversations where role in ('user', 'assistant')), g as (select conv_id, count(*) filter (t <> '') as n, sum(turn % 2) as r, string_agg(t, ' ' order by turn) filter (t <> '') as b from m group by conv_id),
        k as (select *, {category('b', 'qwen')} as cat from g where n > 0) select cast(conv_id as varchar) as external_id, case when cat = 'chat' and r > 0 then 'tool' else cat end as category, n as n_messages, cast(r as bigint) as n_tool_results from k""",
    "takeout_walk": f"""with m as (select *, row_number() over (partition by conv_id order by turn, role, text) as k from conversations), g as (select conv_id, count(*) filter ({strip('text')} <> '') as n, coalesce(string_agg(text, ' ' order by turn) filter ({strip('text')} <> ''), '') as b, arg_min(text, turn) as first, max(case when k = 2 then text end) as reply from m group by conv_id),
        d as (select conv_id, concat_ws(chr(10), case when length(reply) > 50 then 'reply: ' || reply end, case when length(first) > 50 then 'note: ' || first end) as t from g)
        select 'c' || conv_id as external_id, 'conversation' as record_type, case conv_id % 4 when 0 then 'Conversation ' || left('c' || conv_id, 8) else 'A talk' end as title, null::varchar as created_at, {category('b', 'takeout')} as category, n as n_messages, sha256(b) as hash from g where conv_id % 4 < 2
        union all select 'c' || conv_id || 'b', 'conversation', 'None', null, 'chat', 0, sha256('') from g where conv_id % 4 = 1
        union all select 't/c' || conv_id || '.json[0][0]', 'search', first, '2024-01-05T00:00:00', 'chat', 1, sha256(first) from g where conv_id % 4 = 2
        union all select 't/c' || conv_id || '.json', 'document', 'c' || conv_id, null, 'chat', 1, sha256(t) from d where conv_id % 4 = 3 and t <> ''""",
    "record_text": f"""with c as (select conv_id, string_agg(coalesce(nullif(role, ''), 'unknown') || ': ' || text, chr(10) order by turn) filter (text <> '') as said from conversations group by conv_id),
        r as (select doc_id, case when doc_id % 4 = 0 and length(text) > 20 then text else concat_ws(chr(10) || chr(10), 'Title: ' || nullif(source, ''), case when doc_id % 4 < 3 then 'Category: ' || nullif(lang, '') end,
          case when doc_id % 4 = 1 and length(text) > 50 then left(text, 60) end, case when doc_id % 4 = 1 then array_to_string(list_slice(string_split(text, ' '), 1, 10), chr(10)) end,
          nullif(said, ''), case when doc_id % 4 = 3 then left(text, 30) end) end as t from documents left join c on conv_id = doc_id)
        select doc_id, cast(length(t) as bigint) as n_chars, sha256(t) as hash from r""",
    "manifest_metadata": """with p as (select page_id, page_id % 3 < 2 as due, page_id % 7 = 0 as lost, page_id % 5 as e from pages)
        select page_id, case when due and lost then 'failed' when page_id % 3 = 0 then 'pending' when page_id % 3 = 1 then 'failed' else 'ingested' end as status, case when due and lost then 'File not found' end as error,
        case when page_id % 2 = 0 then cast(page_id as varchar) end as kept, case when due and not lost then case e when 0 then 'jsonl_extractor' when 1 then 'archive_extractor' when 2 then 'text_extractor' else 'none' end end as extractor,
        case when due and not lost then case when e <= 2 then 'true' else 'false' end end as processable from p""",
    "incremental_ingest": f"with {RECORDS} select doc_id, sha256(text) as text_sha256, category, round(importance, 6) as importance, cast(case when doc_id % 2 = 0 and doc_id % 6 <> 0 then 0 else 1 end as bigint) as batch from rec",
    "html_to_text": f"with t as (select page_id, {html_text('html')} as t from pages) select page_id, cast(length(t) as bigint) as n_chars, sha256(t) as hash from t",
    "html_block_split": rf"""with b as (select page_id, string_split(html, '<p>')[2:] as bs from pages), e as (select page_id, unnest(range(len(bs))) as n, '<p>' || unnest(bs) as b from b)
        select page_id, cast(n as bigint) as n, {strip(r"regexp_replace(regexp_replace(regexp_replace(b, '<[^>]+>', ' ', 'g'), '&\w+;', ' ', 'g'), '\s+', ' ', 'g')")} as block from e""",
    "recent_records": f"with {DATED} select doc_id, created_at, source from dated where created_at >= date '2024-01-02' order by created_at desc, doc_id limit 50",
    "category_records": f"with {RECORDS} select doc_id, round(importance, 6) as importance, e.ts as created_at from rec join events e on e.event_id = doc_id where category = 'chat' and source = 'src3' order by rec.importance desc, e.ts desc, doc_id limit 20",
    "untitled_records": "select doc_id, title from (select doc_id, case doc_id % 3 when 0 then '' when 1 then 'My Untitled ' || source else source end as title from documents) where title is null or title = '' or title like '%Untitled%'",
    "status_filter": "select event_id, event_type, round(value, 6) as value from events where event_type in ('click', 'view') and value > 10",
    "min_term_match": f"with d as (select doc_id, cast(len({matched(ascii_lower('text'), lst(['tion', 'ther', 'license', 'public']))}) as bigint) as n_matched from documents) select * from d where n_matched >= 3",
    "star_join": "select n_name, count(*) as n, round(cast(sum(cast(l_extendedprice as decimal(18, 2))) as double), 2) as total from lineitem join orders on l_orderkey = o_orderkey join customer on o_custkey = c_custkey join nation on c_nationkey = n_nationkey group by n_name",
    "unchunked_anti": "select doc_id, source from documents where doc_id not in (select doc_id from labels)",
    "semi_in_list": "select doc_id, lang from documents where doc_id in (select doc_id from labels where quality = 0)",
    "preview_first_chunk": f"with {FIXED} select d.doc_id, coalesce(f.piece, '') as preview from documents d left join fixed f on f.doc_id = d.doc_id and f.chunk_index = 0",
    "chunk_counts": f"with {FIXED} select s.source, count(f.doc_id) as n_chunks from (select distinct source from documents) s left join fixed f using (source) group by s.source",
    "late_materialise": "with b as (select doc_id, cast(length(text) as bigint) as score from documents order by score desc, doc_id limit 25) select b.doc_id, score, coalesce(nullif(source, ''), 'unknown') as source, left(text, 100) as head from b join documents using (doc_id)",
    "merge_full_outer": """with a as (select doc_id, n_chars / 1000.0::double as a from documents where doc_id % 2 = 0), b as (select doc_id, 10.0::double / (1 + doc_id % 17) as b from documents where doc_id % 3 = 0)
        select doc_id, round(case when a is not null and b is not null then 1.3::double else 1.0::double end * (0.6::double * coalesce(a, 0) + 0.4::double * coalesce(b, 0)), 6) as score from a full join b using (doc_id)""",
    "index_stats": "select count(*) as n, round(avg(length(text)), 3) as avg_size, cast(min(length(text)) as bigint) as min_size, cast(max(length(text)) as bigint) as max_size, round(count(l.doc_id) / cast(count(*) as double), 6) as coverage from documents d left join (select distinct doc_id from labels) l using (doc_id)",
    "source_distribution": "select source, count(distinct doc_id) as n_docs, count(*) as n from documents group by source",
    "category_distribution": f"with {RECORDS} select category, count(*) as n from rec group by category",
    "daily_activity": "select strftime(ts, '%Y-%m-%d') as day, count(*) as n from events where ts >= date '2024-01-02' group by day order by day desc limit 30",
    "quality_report": f"""with {METRICS} select count(*) as total, cast(count(*) filter ((bm25_candidates > 0 and final_count < 2) or (top_score > 0 and top_score < 1.0)) as bigint) as silent, round(avg(elapsed_ms), 6) as avg_ms, round(avg(final_count), 6) as avg_results,
        round(count(*) filter (final_count = 0) / cast(count(*) as double), 6) as zero_rate, round(count(*) filter (top_score < 2.0) / cast(count(*) as double), 6) as low_rate, round(avg(sources_count), 6) as diversity from m where ts >= date '2024-01-18'""",
    "strategy_breakdown": f"with {METRICS} select coalesce(strategy, 'unknown') as strategy, count(*) as n from m group by 1",
    "slow_queries": f"with {METRICS} select metric_id, query, round(elapsed_ms, 6) as elapsed_ms from m where m.elapsed_ms > 2000 order by m.elapsed_ms desc, metric_id limit 25",
    "zero_results": f"with {METRICS} select metric_id, query, ts from m where final_count = 0 order by ts desc, metric_id limit 25",
    "metric_per_query": "select lang as query_id, count(*) as final_count, count(distinct source) as sources_count, round(max(s), 6) as top_score, round(avg(s), 6) as avg_score, round(max(s) - min(s), 6) as score_spread from (select lang, source, n_chars / 100.0::double as s from documents) group by lang",
    "answer_rubric": """with a as (select turn % 5 as n, lower(coalesce(text, '')) as t from conversations), p as (select (n >= 1)::int + (n >= 3)::int + (t <> '' and not contains(t, 'error'))::int + (t <> '' and not contains(t, 'i don''t have'))::int as p from a)
        select cast(sum(p) as bigint) as points, round(100.0::double * sum(p) / (4 * count(*)), 6) as per_cent from p""",
    "dedup_signature": "select doc_id, n_chars from documents qualify row_number() over (partition by left(text, 120) order by n_chars desc, doc_id) = 1",
    "top_chunks_per_record": f"with {FIXED} select doc_id, chunk_index, sha256(piece) as chunk_hash from fixed where chunk_index < 12",
    "turn_offsets": "select conv_id, turn, cast(coalesce(sum(length(role) + length(text) + 3) over (partition by conv_id order by turn rows between unbounded preceding and 1 preceding), 0) as bigint) as start, cast(length(role) + length(text) + 3 as bigint) as n_chars from conversations",
    "recent_activity": f"with {DATED} select doc_id, created_at, left(text, 80) as title from dated order by created_at desc, doc_id limit 15",
    "record_detail": f"with {FIXED}, g as (select doc_id, count(*) as n, string_agg(piece, '|' order by chunk_index) as b from fixed group by doc_id) select d.doc_id, coalesce(n, 0) as n_chunks, sha256(coalesce(b, '')) as hash from documents d left join g using (doc_id)",
    "answer_context": f"with p as (select doc_id // 10 as query_id, doc_id % 10 + 1 as rank, source, text from documents), c as (select query_id, string_agg({CTX}, chr(10) || chr(10) order by rank) as c from p where rank <= 8 group by query_id) select query_id, sha256(c) as hash, cast(length(c) as bigint) as n_chars from c",
    "tokenize": f"with n as (select doc_id, text, {ascii_lower('text')} as norm from documents) select doc_id, array_to_string({index_tokens('text')}, ' ') as index_tokens, array_to_string({retrieval_tokens('norm')}, ' ') as retrieval_tokens, cast(len({search_terms('norm')}) as bigint) as n_search_terms from n",
    "term_counts": f"select doc_id, {occurrences('l', q('tion'))} as n_tion, {occurrences('l', q('er'))} as n_er, cast(strpos(l, 'tion') - 1 as bigint) as first_tion, cast(case when contains(l, '. ') then length(l) - strpos(reverse(l), ' .') - 1 else -1 end as bigint) as last_stop from (select doc_id, lower(text) as l from documents)",
    "normalize_text": "select doc_id, regexp_replace(lower(strip_accents(text)), '[^\\x00-\\x7F]', '', 'g') as norm from documents",
    "proximity": f"with n as (select doc_id, {ascii_lower('text')} as l from documents), m as (select *, {matched('l', lst(['tion', 'license', 'ther']))} as m from n) select doc_id, round({proximity('l', 'm')}, 6) as bonus from m",
    "code_penalty": f"select page_id, round({code_penalty('html')}, 6) as penalty from pages",
    "recency_weights": f"with {DATED} select doc_id, round(exp(-greatest(floor((epoch_us(timestamp '2024-02-01') - epoch_us(created_at)) / 86400000000.0::double), 0) / 365.0::double), 6) as weight from dated",
    "detect_tools_tasks": f"select page_id, {labels('html', V.TOOLS)} as tools, {labels('html', V.TASKS)} as tasks from pages",
    "extract_files": f"select page_id, array_to_string(list_slice(list_sort(list_distinct({FILES})), 1, 10), '|') as files from (select page_id, url || ' ' || html as x from pages)",
    "summary": f"select conv_id, turn, {summary('x')} as summary from (select conv_id, turn, role || ': ' || text as x from conversations)",
    "keywords": f"select doc_id, {keywords('text')} as keywords from documents",
    "title_heuristic": f"""with l as (select doc_id, text, list_transform(string_split(text, chr(10)), lambda x: {strip('x')}) as ls from documents)
        select doc_id, coalesce({TITLES}[1], {SPOKEN}[1], case when {FIRST_WORDS} <> '' then '[CHAT] ' || left({FIRST_WORDS}, 80) || '...' end) as title, left(list_filter(ls, lambda x: length(x) > 20)[1], 80) as fallback from l""",
    "score_bands": f"with {METRICS} select case when top_score * 1.5 > 5 then 'high' when top_score * 1.5 > 2 then 'mid' else 'low' end as band, count(*) as n from m group by 1",
    "chunk_fixed": f"with {FIXED} select doc_id, chunk_index, cast(pos as bigint) as start_char, cast(stop as bigint) as end_char, sha256(piece) as chunk_hash from fixed",
    "chunk_recursive": f"""with recursive {recursive_chunks("select doc_id, text from documents")}
        select doc_id, row_number() over (partition by doc_id order by o) - 1 as chunk_index, sha256(t) as chunk_hash from every""",
    "chunk_semantic": f"""{SEMANTIC}
        select doc_id, row_number() over (partition by doc_id order by o) - 1 as chunk_index, sha256(t) as chunk_hash from good""",
    "chunk_conversation": f"""with recursive m as (select conv_id, row_number() over (partition by conv_id order by turn) as i, role, role || ': ' || text || chr(10) as line from conversations where coalesce(text, '') <> ''),
        walk as (select conv_id, i, 0 as c, length(line) as size from m where i = 1
          union all select w.conv_id, m.i, case when w.size + length(m.line) > 2000 then w.c + 1 else w.c end, case when w.size + length(m.line) > 2000 then length(m.line) else w.size + length(m.line) end from walk w join m on m.conv_id = w.conv_id and m.i = w.i + 1)
        select conv_id, cast(c as bigint) as chunk_index, count(*) as turn_count, string_agg(distinct role, '|' order by role) as roles, sha256({strip("string_agg(line, '' order by i)")}) as hash from walk join m using (conv_id, i) group by conv_id, c""",
    "chunk_strategy": rf"""with d as (select doc_id, case doc_id % 4 when 0 then '# a' || chr(10) || '## b' || chr(10) || '### c' || chr(10) || text when 1 then '```' || chr(10) || '```' || chr(10) || '```' || chr(10) || '```' || text when 2 then 'user: ' || text || chr(10) || 'assistant: ok' else text end as t,
        case when doc_id % 8 = 2 then 'codex' else source end as s from documents)
        select doc_id, {strategy_of('t', 's')} as strategy from d""",
    "bm25_stats": f"with {POSTINGS} select term, df, round(idf, 6) as idf from idf",
    "bm25_topk": f"with {BM25}, k as (select query_id, doc_id, score, row_number() over (partition by query_id order by round(score, 9) desc, doc_id) as rank from sc where score > 0) select query_id, rank, doc_id, round(score, 4) as score from k where rank <= 10",
    "index_search": f"with {BM25}, k as (select query_id, doc_id, score, row_number() over (partition by query_id order by round(score, 9) desc, doc_id) as rank from sc where score > 0) select query_id, rank, doc_id, round(score, 4) as score from k where rank <= 10",
    "fts_rescore": f"""with n as (select doc_id, {ascii_lower('text')} as l from documents) select doc_id, round(3.0::double * len({matched('l', KEYWORD_TERMS)}) / 3 + {capped('l', KEYWORD_TERMS, 0.5, 2.0)}, 6) as overlap,
        round({capped('l', KEYWORD_TERMS, 0.5, 2.0)} + len({matched('l', KEYWORD_TERMS)}), 3) as keyword from n where {any_of('l', ['tion', 'thon', 'license'])}""",
    "keyword_search": f"""with {RECORDS}, l as (select doc_id, text, importance, {ascii_lower('text')} as l, list_transform(string_split(text, chr(10)), lambda x: {strip('x')}) as ls from rec where category = 'chat'),
        n as (select *, coalesce({TITLES}[1], {SPOKEN}[1], case when {FIRST_WORDS} <> '' then '[CHAT] ' || left({FIRST_WORDS}, 80) || '...' end) as title, {matched('l', lst(['license', 'public', 'tion']))} as m from l),
        s as (select doc_id, text, title, len(m) as n_matched, importance + {capped('l', lst(['license', 'public', 'tion']), 0.7, 2.5)} + cast(1.8 as double) * len(m) + {proximity('l', 'm')} as score from n where len(m) >= 2),
        o as (select * from s qualify row_number() over (partition by left(title, 120), left(text, 120) order by round(score, 9) desc, doc_id) = 1),
        k as (select *, row_number() over (order by round(score, 9) desc, doc_id) as rank from o) select rank, doc_id, round(score, 4) as score, n_matched from k where rank <= 20""",
    "passages": f"""with {FIXED}, {RECORDS}, n as (select f.doc_id, chunk_index, piece, importance, {ascii_lower('piece')} as l from fixed f join rec using (doc_id)), w as (select *, {matched('l', lst(['license', 'version', 'tion']))} as m from n),
        s as (select doc_id, chunk_index, piece, importance + {capped('l', lst(['license', 'version', 'tion']), 0.8, 3.0)} + {proximity('l', 'm')} - {code_penalty('piece')} + cast(1.8 as double) * len(list_distinct(m)) as score from w where len(m) >= 2),
        o as (select * from s qualify row_number() over (partition by doc_id, left(piece, 220) order by round(score, 9) desc, chunk_index) = 1),
        k as (select *, row_number() over (order by round(score, 9) desc, chunk_index, doc_id) as rank from o) select rank, doc_id, chunk_index, round(score, 4) as score from k where rank <= 20""",
    "match_all_terms": f"with {POSTINGS} select doc_id from post where term in ('license', 'version') group by doc_id having count(*) = 2",
    "index_update": f"with {POSTINGS} select term, count(*) as df, cast(sum(tf) as bigint) as cf, count(*) filter (doc_id % 3 = 0 and doc_id in (select doc_id from documents where text is not null and text <> '')) as n_updated from post group by term",
    "match_forms": f"""with tok as (select doc_id, {index_tokens('text')} as ts, ' ' || array_to_string({index_tokens('text')}, ' ') || ' ' as line from documents)
        select 'any' as form, doc_id from tok where list_has_any(ts, ['license', 'public']) union all select 'all', doc_id from tok where list_has_all(ts, ['license', 'version', 'public'])
        union all select 'phrase', doc_id from tok where contains(line, ' general public license ')
        union all select 'mixed', doc_id from tok where list_has_any(ts, ['version', 'work']) and list_contains(ts, 'license') and contains(line, ' public license ') and not list_contains(ts, 'warranty')
        union all select 'none', doc_id from tok where not list_has_any(ts, ['license', 'tion'])""",
    "variant_union": "select variant, rank, key from (select doc_id % 3 as variant, n_chars as rank, left(text, 40) as key from documents) qualify row_number() over (partition by key order by variant, rank) = 1",
    "vector_topk": """with p as (select q.vec_id as query_id, v.vec_id, list_distance(cast(v.embedding as double[]), cast(q.embedding as double[])) as d from embeddings v, embeddings q where q.vec_id % 50 = 0),
        k as (select *, row_number() over (partition by query_id order by d, vec_id) as rank from p) select query_id, rank, vec_id, round(d, 6) as distance, round(greatest(0, 10 - d), 6) as score from k where rank <= 10""",
    "hash_embedding": r"""with w as (select doc_id, list_slice(list_filter(regexp_split_to_array(lower(text), '\s+'), lambda x: x <> ''), 1, 100) as ws from documents), e as (select doc_id, unnest(ws) as w, unnest(range(len(ws))) as i from w), h as (select doc_id, i, md5(w) as h from e),
        b as (select doc_id, i, cast('0x' || substr(h, 2 * j + 1, 2) as integer) as b from h, range(16) as r(j)), g as (select doc_id, b as pos, sum(b / 255.0::double * (1 - i * 0.01::double)) as raw from b group by doc_id, b),
        v as (select doc_id, pos, raw / sqrt(sum(raw * raw) over (partition by doc_id)) as v from g) select doc_id, count(*) as n, round(sum(v * v), 6) as norm, round(max(v), 6) as top, round(sum(v * pos), 4) as mass from v group by doc_id""",
    "embedding_status": r"""with w as (select doc_id, left(coalesce(text, ''), 1000) as t, list_slice(list_filter(regexp_split_to_array(lower(left(coalesce(text, ''), 1000)), '\s+'), lambda x: x <> ''), 1, 100) as ws from documents),
        b as (select distinct doc_id, substr(md5(w), 2 * j + 1, 2) as b from (select doc_id, unnest(ws) as w from w), range(16) as r(j)), n as (select doc_id, count(*) as n from b where b <> '00' group by doc_id)
        select doc_id, 'embedded' as status, case when contains(t, '%') then 'hash' else 'picky' end as model, case when contains(t, '%') then 2 else 1 end as attempt, cast(384 as bigint) as n_places, coalesce(n, 0) as n_set from w left join n using (doc_id)""",
    "hybrid_merge": f"""with {BM25}, a as (select query_id * 50 as query_id, doc_id, score as a from sc where score > 0 qualify row_number() over (partition by query_id order by round(score, 9) desc, doc_id) <= 50),
        p as (select q.vec_id as query_id, v.vec_id as doc_id, list_distance(cast(v.embedding as double[]), cast(q.embedding as double[])) as d from embeddings v, embeddings q where q.vec_id % 50 = 0),
        b as (select query_id, doc_id, greatest(0, 10 - d) as b from p qualify row_number() over (partition by query_id order by d, doc_id) <= 50)
        select query_id, doc_id, round(case when a is not null and b is not null then 1.3::double else 1.0::double end * (0.6::double * coalesce(a, 0) + 0.4::double * coalesce(b, 0)), 4) as score from a full join b using (query_id, doc_id)""",
    "hybrid_search": f"""with recursive {BM25},
        c as materialized (select query_id, doc_id, row_number() over (partition by query_id order by round(score, 9) desc, doc_id) as rank from sc where score > 0),
        t as materialized (select c.query_id, rank, c.doc_id, left(text, 500) as text, query, round({capped('lower(text)', 'own', 0.5, 2.0)} + len({matched('lower(text)', 'own')}), 3) as score from c join documents using (doc_id) join qs using (query_id) where rank <= 50),
        {greedy('t', 'plain')},
        p as (select t.query_id, t.doc_id, t.score, row_number() over (partition by t.query_id order by t.score desc, t.rank) as rank from t join plain using (query_id, rank)),
        j as (select query_id, doc_id, text, rank as was, score as s, {jaccard('sq', 'st')} as r from (select *, {signature('query')} as sq, {signature('text').replace('200', '2000')} as st from t)),
        o as materialized (select query_id, doc_id, text, round(r, 4) as score, row_number() over (partition by query_id order by round(r, 4) desc, place) as rank from (select *, row_number() over (partition by query_id order by round(r, 9) desc, round(s, 9) desc, was) as place from j) where r > 0),
        {greedy('o', 'again')},
        a as (select o.query_id, o.doc_id, o.score, row_number() over (partition by o.query_id order by o.rank) as rank from o join again using (query_id, rank))
        select 'plain' as form, query_id, rank, doc_id, round(score, 4) as score from p where rank <= 10 union all select 'reranked', query_id, rank, doc_id, score from a where rank <= 10""",
    "passages_of_records": f"""with {FIXED}, {RECORDS}, n as (select rec.doc_id, importance, {ascii_lower('text')} as l, e.ts as created_at from rec join events e on e.event_id = doc_id), m as (select *, {matched('l', lst(['license', 'version', 'tion']))} as m from n),
        b as (select *, importance + {capped('l', lst(['license', 'version', 'tion']), 0.7, 2.5)} + cast(1.8 as double) * len(m) + {proximity('l', 'm')} as own from m where len(m) >= 2),
        best as (select * from b order by round(own, 9) desc, created_at desc, doc_id limit 240),
        c as (select b.doc_id, chunk_index, piece, importance, l as whole, {ascii_lower('piece')} as x from best b join fixed f using (doc_id) where chunk_index < 12),
        d as (select *, {matched('x', lst(['license', 'version', 'tion']))} as here, list_filter({lst(['license', 'version', 'tion'])}, lambda t: contains(x, t) or contains(whole, t)) as either from c),
        s as (select doc_id, chunk_index, x, importance + {capped('x', lst(['license', 'version', 'tion']), 0.8, 3.0)} + cast(0.3 as double) * (len(either) - len(here)) + {proximity('x', 'here')} - {code_penalty('piece')} + cast(1.8 as double) * len(either) as score from d where len(either) > 0),
        o as (select * from s qualify row_number() over (partition by doc_id, left(x, 220) order by round(score, 9) desc, chunk_index) = 1),
        k as (select *, row_number() over (order by round(score, 9) desc, chunk_index, doc_id) as rank from o) select rank, doc_id, chunk_index, round(score, 4) as score from k where rank <= 20""",
    "latency_report": f"with {METRICS} select coalesce(strategy, 'unknown') as strategy, count(*) as n, round(min(elapsed_ms), 6) as min_ms, round(avg(elapsed_ms), 6) as avg_ms, round(max(elapsed_ms), 6) as max_ms from m group by 1",
    "profile_context": f"""with p as (select doc_id // 10 as query_id, doc_id % 10 + 1 as rank, source, text from documents), c as (select query_id, string_agg({CTX}, chr(10) || chr(10) order by rank) as c from p where rank <= 8 group by query_id),
        x as (select query_id, concat_ws(chr(10) || chr(10), case when k is not null then concat_ws(chr(10), '- Name: user ' || k, case when k % 2 = 1 then '- Location: Lund' end,
          '- Hardware: ' || nullif(concat_ws('; ', case when k % 6 >= 3 then 'Gpu: a card' end, case when k % 3 > 0 then 'Ram System: 64 GB' end), ''), '- Projects: p' || k) end, c) as c from c left join (select c_custkey as k from customer where c_custkey % 5 <> 0) on k = query_id)
        select query_id, sha256(c) as hash, cast(length(c) as bigint) as n_chars from x""",
    "passage_blocks": """with b as (select doc_id // 10 as query_id, doc_id % 10 + 1 as rank, concat_ws(chr(10), '[Passage ' || (doc_id % 10 + 1) || ']', 'Source: ' || coalesce(nullif(source, ''), 'unknown'), 'Title: ' || case when doc_id % 3 > 0 then coalesce(nullif(lang, ''), 'Untitled') else 'Untitled' end,
          'Created: ' || case when doc_id % 4 > 0 then '2024-01-0' || (doc_id % 9) else 'unknown' end, left(coalesce(text, ''), 420)) as p from documents), c as (select query_id, string_agg(p, chr(10) || chr(10) order by rank) as c from b group by query_id)
        select query_id, sha256(c) as hash, cast(length(c) as bigint) as n_chars from c""",
    "title_from_metadata": "select page_id, case page_id % 4 when 0 then case when length(url) > 3 and length(url) < 100 then url else 'none' end when 1 then 'Topic ' || page_id else 'none' end as title, left(html, 200) || '...' as summary from pages",
    "recency_rank": f"""with {DATED}, w as (select doc_id, n_chars / 5000.0::double as s, case when doc_id % 2 = 0 then 0.0::double else doc_id % 7 / 7.0::double end as r, exp(-greatest(floor((epoch_us(timestamp '2024-02-01') - epoch_us(created_at)) / 86400000000.0::double), 0) / 365.0::double) as c from dated)
        select doc_id, round(case when r > 0 then 0.5::double * r + 0.3::double * s + c else s + 0.8::double * c end, 6) as score from w""",
    "jaccard_pairs": f"""with {LISTED}, w as (select *, {signature('text')} as w from l) select a.query_id, a.rank as first, b.rank as second, round({jaccard('a.w', 'b.w')}, 6) as similarity from w a join w b on a.query_id = b.query_id and a.rank < b.rank where {jaccard('a.w', 'b.w')} > 0.8""",
    "greedy_dedup": f"""with recursive {LISTED}, w as (select *, {signature('text')} as w from l),
        bad as (select a.query_id, a.rank as first, b.rank as second from w a join w b on a.query_id = b.query_id and a.rank < b.rank where {jaccard('a.w', 'b.w')} > 0.8),
        walk as (select query_id, -1::bigint as rank, []::bigint[] as kept from (select distinct query_id from w)
          union all select k.query_id, k.rank + 1, case when exists (select 1 from bad where bad.query_id = k.query_id and bad.second = k.rank + 1 and list_contains(k.kept, bad.first)) or not exists (select 1 from w where w.query_id = k.query_id and w.rank = k.rank + 1) then k.kept else list_append(k.kept, k.rank + 1) end from walk k where k.rank < 39)
        select f.query_id, w.rank, w.doc_id from (select query_id, unnest(kept) as rank from walk where rank = 39) f join w on w.query_id = f.query_id and w.rank = f.rank""",
    "hybrid_retrieve": f"""with recursive {PLANNER.replace(turns_asked(QUESTIONS), values(PLANNED))}, {DATED},
        pl as (select query_id, query, {", ".join(f"case query_type {' '.join(f"when '{t}' then {q(p[i]) if i == 0 else 10 * p[i] if i == 1 else str(p[i]).lower()}" for t, p in V.PLANS.items())} end as {n}" for i, n in enumerate(("strategy", "top_k", "use_reranker")))} from c),
        t0 as (select *, {retrieval_tokens(ascii_lower('query'))} as ts from pl),
        va as (select *, 0 as variant, ts as terms from t0 union all select *, 1, {retrieval_tokens(f"array_to_string(list_concat(ts, flatten(list_transform(ts, lambda t: case t {WIDE} else [] end))), ' ')")} from t0 where len(flatten(list_transform(ts, lambda t: case t {WIDE} else [] end))) > 0),
        n as materialized (select doc_id, {ascii_lower('text')} as l from documents),
        s1 as (select query_id, variant, doc_id, strategy, top_k, 3.0::double * len({matched('l', 'terms')}) / len(terms) + {capped('l', 'terms', 0.5, 2.0)} as score from n, va where length(l) >= 20 and len(terms) > 0 and len({matched('l', 'terms')}) > 0),
        s2 as (select *, row_number() over (partition by query_id, variant order by round(score, 9) desc, doc_id) as rank from s1),
        a as (select query_id, doc_id, score as a from (select * from s2 where rank <= top_k * case strategy when 'long_context' then 5 else 3 end) qualify row_number() over (partition by query_id, doc_id order by variant, rank) = 1),
        vp as (select x.query_id, v.vec_id as doc_id, list_distance(cast(v.embedding as double[]), cast(e.embedding as double[])) as d, top_k from pl x join embeddings e on e.vec_id = x.query_id, embeddings v where strategy = 'hybrid'),
        b as (select query_id, doc_id, greatest(0, 10 - d) as b from vp qualify row_number() over (partition by query_id order by d, doc_id) <= 3 * top_k),
        f as (select query_id, doc_id, a, b, count(a) over (partition by query_id) > 0 as lex, count(b) over (partition by query_id) > 0 as vec from a full join b using (query_id, doc_id)),
        m as (select query_id, doc_id, case when lex and vec then case when a is not null and b is not null then 1.3::double else 1.0::double end * (0.6::double * coalesce(a, 0) + 0.4::double * coalesce(b, 0)) when vec then 0.4::double * b else 0.6::double * a end as score from f),
        w as materialized (select m.query_id, m.doc_id, score, text, created_at, query, strategy, top_k, use_reranker, {signature('text')} as w, row_number() over (partition by m.query_id order by round(score, 9) desc, m.doc_id) as rank from m join dated using (doc_id) join pl using (query_id)),
        bad as materialized (select x.query_id, x.rank as first, y.rank as second from w x join w y on x.query_id = y.query_id and x.rank < y.rank where {jaccard('x.w', 'y.w')} > 0.8),
        walk as (select query_id, 0::bigint as rank, []::bigint[] as kept, max(rank) as last from w group by query_id
          union all select k.query_id, k.rank + 1, case when exists (select 1 from bad where bad.query_id = k.query_id and bad.second = k.rank + 1 and list_contains(k.kept, bad.first)) then k.kept else list_append(k.kept, k.rank + 1) end, k.last from walk k where k.rank < k.last),
        u as (select w.*, count(*) over (partition by w.query_id) as n from (select query_id, unnest(kept) as rank from walk where rank = last) g join w using (query_id, rank)),
        r as (select *, case when use_reranker and strategy <> 'bm25_only' and n > top_k then {jaccard('sq', 'st')} end as rerank from (select *, {signature('query')} as sq, {signature('text').replace('200', '2000')} as st from u)),
        r2 as (select *, row_number() over (partition by query_id order by round(rerank, 9) desc, round(score, 9) desc, rank) as place from r),
        z as (select query_id, doc_id, top_k, case when rerank > 0 then 0.5::double * rerank + 0.3::double * score + rc else score + 0.8::double * rc end as score from (select *, exp(-greatest(floor((epoch_us(timestamp '2024-02-01') - epoch_us(created_at)) / 86400000000.0::double), 0) / 365.0::double) as rc from r2 where rerank is null or place <= 2 * top_k)),
        y as (select *, row_number() over (partition by query_id order by round(score, 9) desc, doc_id) as rank from z)
        select query_id, rank, doc_id, round(score, 4) as score from y where rank <= top_k""",
    "classify_queries": f"with {PLANNER} select query_id, query_type, round(confidence, 6) as confidence from c",
    "plan_queries": f"with {PLANNER} select query_id, " + ", ".join(f"case query_type {' '.join(f"when '{t}' then {(q(p[i]) if i == 0 else 10 * p[i] if i == 1 else str(p[i]).lower())}" for t, p in V.PLANS.items())} end as {n}" for i, n in enumerate(("strategy", "top_k", "use_reranker", "use_vectors", "recency_boost"))) + " from c",
    "temporal_expansion": rf"""select query_id, unnest(list_filter([query, query || ' recent latest new', case when regexp_matches(lower(query), '(\d+)\s+(days?|weeks?|months?)\s+ago') then query || ' activity work discussion' end], lambda x: x is not null)) as expanded from {turns_asked(QUESTIONS)}""",
    "daily_window_metrics": f"with {METRICS} select strftime(ts, '%Y-%m-%d') as day, count(*) as n, round(avg(elapsed_ms), 6) as avg_ms, cast(count(*) filter (elapsed_ms > 2000) as bigint) as slow from m group by 1",
    "enrichment": f"select conv_id, turn, {labels('text', V.TASKS)} as tasks, {summary('text')} as summary, {keywords('text')} as keywords from conversations where length(text) >= 50",
    "classification_report": """with m as (select doc_id % 5 as e from documents where doc_id % 3 <> 2) select count(*) as n_files, count(*) filter (e <= 2) as n_processable, count(*) filter (e > 2) as n_others,
        array_to_string(list_sort(list_distinct(list(case e when 0 then 'jsonl_extractor' when 1 then 'takeout_extractor' when 2 then 'text_extractor' end) filter (e <= 2))), '|') as extractors from m""",
    "title_pipeline": f"""with {RECORDS}, l as (select doc_id, text, category, list_transform(string_split(text, chr(10)), lambda x: {strip('x')}) as ls from rec where doc_id % 2 = 0),
        t as (select doc_id, coalesce({TITLES}[1], {SPOKEN}[1], case when {FIRST_WORDS} <> '' then '[' || upper(category) || '] ' || left({FIRST_WORDS}, 80) || '...' end) as title from l where category <> 'code') select * from t where title is not null""",
    "enrich_records": f"""select doc_id, {labels('text', V.TOOLS)} as tools, {labels('text', V.TASKS)} as tasks, array_to_string(list_slice(list_sort(list_distinct({FILES.replace("(x,", "(text,")})), 1, 10), '|') as files, {summary('text')} as summary from documents where length(text) >= 50""",
    "enrichment_pipeline": f"""with {FIXED}, g as (select doc_id, string_agg(piece, chr(10) order by chunk_index) as parts from fixed where chunk_index < 5 group by doc_id),
        d as (select doc_id, case when doc_id % 3 = 0 then left(coalesce(text, ''), 30) else coalesce(text, '') end as t from documents where doc_id not in (select doc_id from labels where quality = 0)),
        e as (select doc_id, case when length(t) < 50 then parts else t end as text from d left join g using (doc_id))
        select doc_id, {labels('text', V.TOOLS)} as tools, {labels('text', V.TASKS)} as tasks, array_to_string(list_slice(list_sort(list_distinct({FILES.replace("(x,", "(text,")})), 1, 10), '|') as files, {keywords('text')} as keywords, {summary('text')} as summary from e where length(text) >= 50""",
    "find_precedence": f"""with {RECORDS}, dt as (select rec.*, e.ts as created_at from rec join events e on e.event_id = doc_id),
        l as (select doc_id, text, importance, {ascii_lower('text')} as l, list_transform(string_split(text, chr(10)), lambda x: {strip('x')}) as ls from dt),
        n as (select *, coalesce({TITLES}[1], {SPOKEN}[1], case when {FIRST_WORDS} <> '' then '[CHAT] ' || left({FIRST_WORDS}, 80) || '...' end) as title, {matched('l', lst(['license', 'public', 'tion']))} as m from l),
        s as (select doc_id, text, title, importance + {capped('l', lst(['license', 'public', 'tion']), 0.7, 2.5)} + cast(1.8 as double) * len(m) + {proximity('l', 'm')} as score from n where len(m) >= 2),
        o as (select * from s qualify row_number() over (partition by left(title, 120), left(text, 120) order by round(score, 9) desc, doc_id) = 1),
        q as (select doc_id from o order by round(score, 9) desc, doc_id limit 20),
        c as (select doc_id from dt where category = 'chat' order by importance desc, created_at desc, doc_id limit 20),
        latest as (select doc_id from dt order by created_at desc, importance desc, doc_id limit 20)
        select 'by_id' as call, cast(3 as bigint) as doc_id union all select 'recent', doc_id from latest union all select 'category', doc_id from c union all select 'query', doc_id from q""",
}
