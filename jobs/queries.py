"""The jobs as queries: each runs twice into one new folder, and what stands there after the second run is the result."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from jobs import archive, search_index
from tessera.functions import fixed_values as V
from tessera.oracles import POSTINGS, category, fixed_chunks, html_text, importance, keywords, labels, recursive_chunks, semantic_chunks, strategy_of, strip, summary
from tessera.session import new_folder


def job1_search_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    home = new_folder(spark, "job1")
    for _ in range(2):
        index = search_index.run(spark, f"{sf_dir}/documents.parquet", home)
    return index.where("bucket >= 0").select("term", "doc_id", "dl", "tf", F.col("positions")[0].cast("long").alias("first_position"), F.element_at("positions", -1).cast("long").alias("last_position"))


def job2_archive(spark: SparkSession, sf_dir: str) -> DataFrame:
    home = new_folder(spark, "job2")
    for _ in range(2):
        records = archive.run(spark, home, *[f"{sf_dir}/{t}.parquet" for t in ("documents", "pages", "conversations")])
    joined = [F.array_join(c, "|").alias(c) for c in ("tools", "tasks", "keywords")]
    return records.select("record_type", "record_id", "source", "category", F.round("importance", 6).alias("importance"), "title", "n_chars", "n_copies", *joined, "summary", "text_sha256", "n_chunks")


QUERIES = {f.__name__: f for f in (job1_search_index, job2_archive)}

_TEXTS = f"""raw as (select 'document' as record_type, doc_id as record_id, source, coalesce(text, '') as text from documents where doc_id is not null
      union all select 'page', page_id, regexp_extract(url, '^[a-zA-Z]+://([^/?#:]+)', 1), {html_text('html')} from pages where page_id is not null
      union all select 'conversation', conv_id, 'conversations', string_agg(coalesce(nullif(role, ''), 'unknown') || ': ' || text, chr(10) || chr(10) order by turn) from conversations where conv_id is not null and {strip('text')} <> '' group by conv_id),
    kept as (select record_type, record_id, coalesce(nullif(source, ''), 'unknown') as source, text, count(*) over (partition by record_type, text) as n_copies,
                    row_number() over (partition by record_type, text order by record_id) as copy, record_type || '/' || record_id as doc_id from raw),
    recs as (select *, case record_type when 'page' then {category('text', 'takeout')} when 'conversation' then {category('text', 'factory')} else {category('text')} end as category from kept where copy = 1),
    strategies as (select doc_id, text, {strategy_of('text', 'source')} as strategy from recs where record_type <> 'conversation')"""

_OF = lambda s: f"select doc_id, text from strategies where strategy = '{s}'"
_CUT = " union all ".join(f"select doc_id, count(*) as n from (with recursive {f(_OF(s))} select doc_id from {last}) group by doc_id" for s, f, last in (("recursive", recursive_chunks, "every"), ("semantic", semantic_chunks, "good"), ("fixed", fixed_chunks, "fixed")))

ORACLES = {
    "job1_search_index": f"""with {POSTINGS} select term, doc_id, len(ts) as dl, count(*) as tf, min(pos) as first_position, max(pos) as last_position
        from (select doc_id, ts, unnest(ts) as term, unnest(range(len(ts))) as pos from tok where doc_id is not null) group by all""",
    "job2_archive": f"""with recursive {_TEXTS},
        m as (select conv_id, row_number() over (partition by conv_id order by turn) as i, coalesce(nullif(role, ''), 'unknown') || ': ' || text || chr(10) as line from conversations where {strip('text')} <> ''),
        talk as (select conv_id, i, 0 as c, length(line) as size from m where i = 1
          union all select w.conv_id, m.i, case when w.size + length(m.line) > 2000 then w.c + 1 else w.c end, case when w.size + length(m.line) > 2000 then length(m.line) else w.size + length(m.line) end from talk w join m on m.conv_id = w.conv_id and m.i = w.i + 1),
        cut as ({_CUT} union all select 'conversation/' || conv_id, max(c) + 1 from talk group by conv_id)
        select record_type, record_id, source, category, round({importance('category', 'text')}, 6) as importance,
               coalesce(nullif(left(list_filter(list_transform(string_split(text, chr(10)), lambda x: {strip('x')}), lambda x: length(x) > 20)[1], 80), ''), 'Untitled') as title, cast(length(text) as bigint) as n_chars, n_copies,
               {labels('text', V.TOOLS)} as tools, {labels('text', V.TASKS)} as tasks, {keywords('text')} as keywords, {summary('text')} as summary, sha256(text) as text_sha256, cast(coalesce(n, 0) as bigint) as n_chunks
        from recs left join cut using (doc_id)""",
}
