"""One query for each operator, over its whole table, and the SQL of those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


#: Stands for a secret that a deployment passes to pseudonymise().
KEY = "example key"


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .substring_dedup import shared_passages

    return shared_passages(_table(spark, sf_dir, "documents"))


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .compression_quality import quality_report

    return quality_report(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .line_dedup import drop_repeated_lines

    out = drop_repeated_lines(_table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_lines", "n_deleted", "longest_run", F.sha2("text", 256).alias("text_sha256"))


def op4_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .mixing import mix

    return mix(_table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken", "source", "copies")


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from .token_counts import count_tokens

    return count_tokens(_table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .simhash import near_duplicates

    return near_duplicates(_table(spark, sf_dir, "documents"))


def op7_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .pii import pseudonymise

    return pseudonymise(_table(spark, sf_dir, "documents").select("doc_id", "text"), KEY)


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .toxicity import toxicity_report

    return toxicity_report(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op9_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .decontaminate import contamination

    return contamination(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark")).drop("h", "spans")


def op10_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .topk import exact_top_k

    return exact_top_k(_table(spark, sf_dir, "embeddings"), lambda c: c % 50 == 0)


def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .filter_audit import audit

    return audit(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op12_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .sketches import fingerprints

    return fingerprints(_table(spark, sf_dir, "documents"))


QUERIES = {f.__name__: f for f in (op1_substrings, op2_quality, op3_line_dedup, op4_mix, op5_token_counts, op6_simhash, op7_pii, op8_toxicity, op9_decontaminate, op10_topk, op11_filter_audit, op12_fingerprints)}

#: The contract's word pattern and the letters to lower-case.
_FOLD = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORDS = rf"regexp_extract_all({_FOLD}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

_BLANK = "(' ' || chr(9) || chr(13) || chr(11) || chr(12))"

ORACLES: dict[str, str] = {
    "op3_line_dedup": f"""
        with d as (select row_number() over () as r, doc_id, text, string_split(text, chr(10)) as ls from documents),
        n as (select r, doc_id, ln, raw, trim(raw, {_BLANK}) as line from (select r, doc_id, unnest(range(len(ls))) as ln, unnest(ls) as raw from d)),
        l as (select *, row_number() over (partition by r order by ln) as k from n where line <> ''),
        m as (select *, lead(line) over (partition by r order by k) as nxt, row_number() over (partition by line order by doc_id nulls first, k) > 1 as later from l),
        p as (select *, nxt is not null and row_number() over (partition by line, nxt order by doc_id nulls first, k) > 1 as pair from m),
        g as (select *, (later and regexp_matches(line, '\\S+\\s+\\S')) or pair or coalesce(lag(pair) over (partition by r order by k), false) as gone from p),
        a as (select x.r, x.k, y.r as r2, x.k - y.k as diagonal from l x join l y on x.line = y.line and (x.r <> y.r or x.k <> y.k)),
        i as (select r, k - row_number() over (partition by r, r2, diagonal order by k) as island, r2, diagonal from a),
        longest as (select r, max(size) as longest_run from (select r, count(*) as size from i group by r, r2, diagonal, island) group by r),
        c as (select r, count(*) as n_lines, count(*) filter (gone) as n_deleted from g group by r),
        t as (select n.r, string_agg(n.raw, chr(10) order by n.ln) as rest, bool_or(n.line <> '') as any_line from n left join g on g.r = n.r and g.ln = n.ln where not coalesce(g.gone, false) group by n.r)
        select doc_id, coalesce(n_lines, 0) as n_lines, coalesce(n_deleted, 0) as n_deleted, coalesce(longest_run, 0) as longest_run,
               sha256(case when coalesce(n_deleted, 0) = 0 then text when any_line then rest else '' end) as text_sha256
        from d left join c using (r) left join longest using (r) left join t using (r)""",
    "op9_decontaminate": f"""
        with d as (select row_number() over () as r, doc_id, {_WORDS} as w from documents),
        i as (select distinct cast(item_id as varchar) as item_id, {_WORDS} as w from benchmark),
        iw as (select distinct item_id, least(len(w), 10) as n, array_to_string(list_slice(w, s, s + least(len(w), 10) - 1), ' ') as g
               from (select item_id, w, unnest(range(1, len(w) - least(len(w), 10) + 2)) as s from i where len(w) > 0)),
        sizes as (select distinct n from iw),
        dw as (select r, s, n, array_to_string(list_slice(w, s, s + n - 1), ' ') as g
               from (select r, w, n, unnest(range(1, len(w) - n + 2)) as s from d, sizes where len(w) >= n)),
        m as (select dw.r, dw.s, dw.n, iw.item_id from dw join iw on dw.g = iw.g and dw.n = iw.n),
        hit as (select r, count(distinct p) as n_hit from (select r, unnest(range(s, s + n)) as p from m) group by r),
        its as (select r, count(*) as n_items, string_agg(item_id, ',' order by item_id) as ids from (select distinct r, item_id from m) group by r)
        select d.doc_id, cast(len(w) as bigint) as n_words, cast(coalesce(n_hit, 0) as bigint) as n_hit, cast(coalesce(n_items, 0) as bigint) as n_items,
               sha256(coalesce(ids, '')) as items_sha256, coalesce(n_hit, 0) > 0 as contaminated
        from d left join hit using (r) left join its using (r)""",
    "op11_filter_audit": r"""
        with t as (select doc_id, coalesce(source, '') as part, coalesce(text, '') as text from documents),
        w as (select *, regexp_extract_all(text, '[^\x20\x09-\x0D]+') as ws from t),
        first as (select text, min(doc_id) as id from t group by text),
        marks as (select doc_id, max(case when quality = 1 then 1 else 0 end) as good, max(case when toxic = 1 then 1 else 0 end) as toxic from labels group by doc_id),
        fails as (select w.part, len(ws) < 200 as fa, 100 * len(list_distinct(ws)) < 50 * len(ws) as fb,
                         100 * len(regexp_extract_all(w.text, '[A-Z]')) > 2 * length(w.text) as fc, regexp_matches(w.text, '[#$%&*|]') as fd,
                         coalesce(w.doc_id > first.id, false) as fe, coalesce(good, 0) as good, coalesce(toxic, 0) as toxic
                  from w join first on w.text = first.text left join marks on w.doc_id = marks.doc_id),
        c as (select part, (case when fa then 'A' else '' end) || (case when fb then 'B' else '' end) || (case when fc then 'C' else '' end)
                     || (case when fd then 'D' else '' end) || (case when fe then 'E' else '' end) as failed, count(*) as n, sum(good) as good, sum(toxic) as toxic
              from fails group by all),
        l as (select unnest(['A', 'B', 'C', 'D', 'E']) as x),
        o as (select a.x || b.x || c.x || d.x || e.x as filter_order from l a, l b, l c, l d, l e
              where len(list_distinct([a.x, b.x, c.x, d.x, e.x])) = 5),
        s as (select filter_order, step, substr(filter_order, step, 1) as f, substr(filter_order, 1, step - 1) as before from o, (select unnest(range(1, 6)) as step)),
        x as (select part, filter_order, step, f, n, good, toxic, failed, contains(failed, f) as own, before <> '' and regexp_matches(failed, '[' || before || '.]') as earlier from c, s),
        g as (select part, filter_order, cast(step as integer) as step, f, sum(case when not own and not earlier then n else 0 end) as kept, sum(case when own and not earlier then n else 0 end) as removed,
                     sum(case when own and earlier then n else 0 end) as redundant, sum(case when failed = f then n else 0 end) as unique_fails,
                     sum(case when own and not earlier then good else 0 end) as good_lost, sum(case when own and not earlier then toxic else 0 end) as toxic_lost
              from x group by all)
        select part, filter_order, step, cast(kept as bigint) as kept, cast(removed as bigint) as removed, cast(redundant as bigint) as redundant,
               cast(unique_fails as bigint) as unique_fails, cast(good_lost as bigint) as good_lost, cast(toxic_lost as bigint) as toxic_lost,
               cast(sum(removed) over (partition by part, f) as bigint) as shapley from g""",
    "op12_fingerprints": r"""
        with t as (select doc_id, coalesce(text, '') as text, cast(length(coalesce(text, '')) as bigint) as n_chars from documents),
        f as (select *, coalesce(lead(text) over w, first_value(text) over w) as following, coalesce(lead(r) over w, first_value(r) over w) as next_r
              from (select *, row_number() over (order by doc_id nulls first, md5(text)) as r from t) window w as (order by r)),
        e as (select *, left(text, n_chars - n_chars // 4) || left(following, n_chars // 4) as edited from f),
        s as (select r, false as edit, regexp_extract_all(text, '[^\x20\x09-\x0D]+') as ws from e union all select r, true, regexp_extract_all(edited, '[^\x20\x09-\x0D]+') from e),
        h as (select r, edit, list_sort(list_distinct(case when len(ws) = 0 then [] when len(ws) < 5 then [left(md5(array_to_string(ws, ' ')), 16)]
                     else list_transform(range(1, len(ws) - 3), lambda i: left(md5(array_to_string(ws[i:i + 4], ' ')), 16)) end))[1:256] as k from s),
        c as (select e.*, a.k as a, b.k as b, c.k as c, list_sort(list_distinct(list_concat(a.k, b.k)))[1:256] as ab, list_sort(list_distinct(list_concat(a.k, c.k)))[1:256] as ac
              from e join h a on a.r = e.r and not a.edit join h b on b.r = e.r and b.edit join h c on c.r = e.next_r and not c.edit),
        d as (select *, case when len(ab) = 0 then 1.0::double else len(list_filter(ab, lambda x: list_contains(a, x) and list_contains(b, x))) / len(ab)::double end as near_edited,
                     case when len(ac) = 0 then 1.0::double else len(list_filter(ac, lambda x: list_contains(a, x) and list_contains(c, x))) / len(ac)::double end as near_next,
                     case when len(a) < 256 then len(a)::double else 255 / ((('0x' || left(a[-1], 8))::bigint * 4294967296.0::double + ('0x' || right(a[-1], 8))::bigint::double + 1) / 18446744073709551616.0::double) end as size_a,
                     case when len(ab) < 256 then len(ab)::double else 255 / ((('0x' || left(ab[-1], 8))::bigint * 4294967296.0::double + ('0x' || right(ab[-1], 8))::bigint::double + 1) / 18446744073709551616.0::double) end as size_ab from c)
        select doc_id, n_chars, sha256(edited) as edited_sha256, array_to_string(a, '') as fingerprint, array_to_string(b, '') as edited_fingerprint, near_edited, near_next,
               cast(round(size_a) as bigint) as n_shingles, round(case when len(a) = 0 then 1.0::double else least(1.0::double, near_edited * size_ab / size_a) end, 6) as kept from d""",
    "op10_topk": """
        with v as (select vec_id, list_transform(embedding, lambda x: cast(floor(256 * cast(x as double)) as bigint)) as w
                   from embeddings where vec_id is not null and embedding is not null
                   and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
        s as (select q.vec_id as query_id, c.vec_id as vec_id, cast(list_sum(list_transform(list_zip(q.w, c.w), lambda p: p[1] * p[2])) as bigint) as score
              from v q join v c on q.vec_id <> c.vec_id where q.vec_id % 50 = 0),
        t as (select query_id, cast(row_number() over (partition by query_id order by score desc, vec_id) as integer) as rank, vec_id, score from s)
        select * from t where rank <= 5""",
}
