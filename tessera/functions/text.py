"""Text functions as Column expressions; they stay inside the JVM, but for normalize_text() and rare entities."""

from __future__ import annotations

import html
import unicodedata
from collections.abc import Callable
from functools import reduce

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from . import fixed_values as V

SPACES = " \t\n\r\x0b\x0c"


def let(value: Column, then: Callable[[Column], Column]) -> Column:
    """then(value), with value evaluated once: inside a lambda an expression would be evaluated again for each element."""
    return F.transform(F.array(value), then)[0]


def strip(c: Column) -> Column:
    return F.trim(c, F.lit(SPACES))


def or_default(c: Column, default: str) -> Column:
    """Null and empty strings become the default."""
    return F.coalesce(F.nullif(c, F.lit("")), F.lit(default))


def _ascii(text: str) -> str:
    return unicodedata.normalize("NFKD", text).encode("ascii", "ignore").decode("ascii")


@F.pandas_udf(StringType())
def _normalize_any(s: pd.Series) -> pd.Series:
    return s.map(_ascii, na_action="ignore")


# Latin letters with accents, each of which decomposes to one ASCII letter; and what has nothing in ASCII, so that it goes.
ACCENTED = "".join(chr(n) for n in range(0xC0, 0x250) if len(_ascii(chr(n))) == 1)
DROPPED = "".join(chr(n) for n in range(0x80, 0x250) if not _ascii(chr(n)))


def normalize_text(c: Column) -> Column:
    """Compatibility decomposition, ASCII only, lower case. Accented Latin letters are translated by a built-in; only texts with other characters, which may have any decomposition, go through Python."""
    c = F.coalesce(c, F.lit(""))
    plain = F.translate(c, ACCENTED + DROPPED, _ascii(ACCENTED))
    rare = F.when(plain.rlike(r"[^\x00-\x7F]"), c)
    return F.lower(F.coalesce(_normalize_any(rare), plain))


def ascii_lower(c: Column) -> Column:
    """normalize_text for text without accents or compatibility characters: drops what isn't ASCII. Built-in."""
    return F.lower(F.regexp_replace(F.coalesce(c, F.lit("")), r"[^\x00-\x7F]", ""))


def _runs(c: Column, letters: str, least: int, stop: list[str]) -> Column:
    """The runs of at least so many of the letters that aren't stop words. (Matching a class is some times faster than splitting at its complement.)"""
    return F.filter(F.regexp_extract_all(c, F.lit(f"[{letters}]{{{least},}}"), F.lit(0)), lambda t: ~t.isin(stop))


def index_tokens(c: Column) -> Column:
    return _runs(F.lower(c), "a-z0-9À-ɏ", 3, V.INDEX_STOP_WORDS)


def retrieval_tokens(normalized: Column) -> Column:
    return _runs(normalized, "a-z0-9", 3, V.RETRIEVAL_STOP_WORDS)


def search_terms(normalized: Column) -> Column:
    return _runs(normalized, "a-z0-9_-", 3, V.SEARCH_STOP_WORDS)


def occurrences(text: Column, needle: Column | str) -> Column:
    """Non-overlapping occurrences of a non-empty needle."""
    needle = F.lit(needle) if isinstance(needle, str) else needle
    return ((F.length(text) - F.length(F.replace(text, needle, F.lit("")))) / F.length(needle)).cast("long")


def first_position(text: Column, needle: Column) -> Column:
    """From 0; -1 if absent."""
    return F.position(needle, text) - 1


def last_position(text: Column, needle: str) -> Column:
    """From 0; -1 if absent."""
    at = F.instr(F.reverse(text), needle[::-1])
    return F.when(at == 0, -1).otherwise(F.length(text) - at - len(needle) + 1)


def matched_terms(text: Column, terms: Column) -> Column:
    return let(text, lambda x: F.filter(terms, lambda t: F.contains(x, t)))


def least_matches(terms: Column) -> Column:
    return F.when(F.size(terms) >= 4, 3).when(F.size(terms) >= 2, 2).otherwise(1)


def proximity(text: Column, matched: Column) -> Column:
    """4, less the span of the first positions in steps of 220 characters; 0 for fewer than two terms."""
    at = let(text, lambda x: F.transform(matched, lambda t: F.position(t, x)))
    return let(at, lambda a: F.when(F.size(a) < 2, 0.0).otherwise(F.greatest(F.lit(0.0), 4.0 - (F.array_max(a) - F.array_min(a)) / 220.0)))


def capped_counts(text: Column, terms: Column, weight: float, cap: float) -> Column:
    """Sum over terms of min(weight * occurrences, cap)."""
    return let(text, lambda x: F.aggregate(terms, F.lit(0.0), lambda s, t: s + F.least(weight * occurrences(x, t), F.lit(cap))))


def code_penalty(text: Column) -> Column:
    return let(F.lower(text), lambda low: F.least(sum((occurrences(low, n) for n in V.CODE_NEEDLES), F.lit(0)) * 0.4, F.lit(4.0)))


def recency_weight(created: Column, as_of: Column, decay: float = 365.0) -> Column:
    """exp(-whole days / decay), at most 1; 0.5 without a time."""
    days = F.floor((F.unix_micros(as_of.cast("timestamp")) - F.unix_micros(created.cast("timestamp"))) / 86_400_000_000)
    return F.when(days.isNull(), 0.5).otherwise(F.exp(-F.greatest(days, F.lit(0)) / decay))


def any_of(text: Column, needles: list[str]) -> Column:
    return reduce(lambda a, b: a | b, (F.contains(text, F.lit(n)) for n in needles))


def category(text: Column, form: str = "jsonl", low: Column | None = None) -> Column:
    """low: a column of the text in lower case, where there is one; else each needle's branch lowers the text anew."""
    low = F.lower(text) if low is None else low
    out = F.lit("chat")
    for name, needles in reversed(V.CATEGORY_KEYWORDS[form].items()):
        out = F.when(any_of(low, needles), name).otherwise(out)
    return out


def importance(category: Column, text: Column) -> Column:
    base = F.lit(0.5)
    for name, value in V.IMPORTANCE.items():
        base = F.when(category == name, value).otherwise(base)
    return base + F.when(F.length(text) > 1000, 0.1).otherwise(0.0)


@F.pandas_udf(StringType())
def _every_entity(s: pd.Series) -> pd.Series:
    return s.map(html.unescape, na_action="ignore")


# The entities that most pages have, which need no lookup.
COMMON_ENTITIES = {"nbsp": " ", "lt": "<", "gt": ">", "quot": '"', "#39": "'", "apos": "'", "copy": "©", "middot": "·", "amp": "&"}


def unescape(c: Column) -> Column:
    """Character references resolved as HTML says: all names, also those that may lack their semicolon, and numbers (with its table for 0x80 to 0x9F, and U+FFFD for what is no character). Only texts with others than the commonest go through Python."""
    plain = c
    for name, char in COMMON_ENTITIES.items():
        plain = F.replace(plain, F.lit(f"&{name};"), F.lit(char))
    rare = F.when(c.rlike("&(?!(?:" + "|".join(COMMON_ENTITIES) + ");)[#A-Za-z]"), c)
    return F.coalesce(_every_entity(rare), plain)


def html_to_text(c: Column) -> Column:
    """Visible text, one cleaned line a block; lines of one character go."""
    c = F.regexp_replace(c, r"(?is)<script.*?>.*?</script>|<style.*?>.*?</style>", " ")
    c = F.regexp_replace(c, r"(?i)<br\s*/?>|</p>|</div>|</li>|</tr>|</h[1-6]>", "\n")
    c = unescape(F.regexp_replace(c, r"(?s)<[^>]+>", " "))
    lines = F.transform(F.split(c, r"\r\n|[\n\r\x0B\x0C\x1C-\x1E\x85\u2028\u2029]"), lambda x: F.trim(F.regexp_replace(x, r"[\s\p{Z}\x1C-\x1F\x85]+", " ")))
    return F.array_join(F.filter(lines, lambda x: F.length(x) >= 2), "\n")


def strip_reminder(c: Column) -> Column:
    return F.substring_index(c, "</system-reminder>", -1)


def clean_message(c: Column) -> Column:
    """Blocks without thinking tags; blocks that are serialised thoughts go."""
    blocks = F.transform(F.split(F.regexp_replace(F.coalesce(c, F.lit("")), "</?thinking>", "\n"), "\n\n"), strip)
    thought = lambda b: (b.startswith("{") | b.startswith("[")) & b.contains('"description"') & b.contains('"subject"')
    return F.array_join(F.filter(blocks, lambda b: (b != "") & ~thought(b)), "\n\n")


def labels_found(text: Column, table: dict[str, list[str]], low: Column | None = None) -> Column:
    """low: as category() takes it."""
    low = F.lower(text) if low is None else low
    return F.array_sort(F.array_compact(F.array(*[F.when(any_of(low, needles), name) for name, needles in table.items()])))


def files_named(text: Column) -> Column:
    paths = F.regexp_extract_all(text, F.lit(r"[/\\][\w\-\.]+(?:/[\w\-\.]+){1,5}"), F.lit(0))
    names = F.regexp_extract_all(text, F.lit(r"[\w\-]+\.(?:%s)" % "|".join(V.FILE_EXTENSIONS)), F.lit(0))
    return F.slice(F.array_sort(F.array_distinct(F.concat(paths, names))), 1, 10)


def summary(text: Column, most: int = 200) -> Column:
    """The first prose lines of over 20 characters, cut at `most`; speaker prefixes go, code lines are skipped."""
    code = lambda x: reduce(lambda a, b: a | b, (x.startswith(s) for s in V.CODE_LINE_STARTS))
    spoken = lambda x: strip(F.when(x.startswith("assistant:"), F.substring(x, F.lit(11), F.length(x))).when(x.startswith("user:"), F.substring(x, F.lit(6), F.length(x))).otherwise(x))
    lines = F.filter(F.transform(F.filter(F.transform(F.split(text, "\n"), strip), lambda x: (x != "") & ~code(x)), spoken), lambda x: F.length(x) > 20)
    return F.left(F.array_join(lines, "\n"), F.lit(most))


def keywords(text: Column) -> Column:
    return F.slice(F.array_sort(F.array_distinct(_runs(F.lower(text), "a-z", 4, V.KEYWORD_STOP_WORDS))), 1, 30)


def title_heuristic(text: Column, category: Column) -> Column:
    """A marked title, else a definition's name, else a middle-sized line without its speaker, else the category and the first words."""
    lines = F.transform(F.split(text, "\n"), strip)
    marked = F.filter(F.slice(lines, 1, 10), lambda x: x.startswith("Title:") | x.startswith("# "))
    after = lambda x, mark: F.when(x.contains(mark), F.substring(x, F.position(F.lit(mark), x) + 1, F.length(x))).otherwise(x)
    titles = F.filter(F.transform(marked, lambda x: strip(after(after(x, ":"), "#"))), lambda x: (F.length(x) > 5) & (F.length(x) < 100))
    defined = F.filter(F.slice(lines, 1, 30), lambda x: x.contains("def ") | x.contains("class "))
    name = lambda x: strip(F.substring_index(F.substring_index(F.substring_index(F.substring_index(x, "def ", -1), "class ", -1), "(", 1), ":", 1))
    names = F.filter(F.transform(defined, name), lambda x: x.rlike(r"^\p{L}"))
    middle = F.filter(F.slice(lines, 1, 5), lambda x: (F.length(x) > 20) & (F.length(x) < 100))
    spoken = F.filter(F.transform(middle, lambda x: F.regexp_replace(x, r"^(?:User:|Assistant:|System:|Human:|AI:)\s*", "")), lambda x: F.length(x) > 20)
    first = F.array_join(F.slice(F.filter(F.split(text, r"\s+"), lambda w: w != ""), 1, 15), " ")
    fallback = F.when(first != "", F.concat(F.lit("["), F.upper(category), F.lit("] "), F.left(first, F.lit(80)), F.lit("...")))
    return F.coalesce(F.get(titles, F.lit(0)), F.when(category == "code", F.concat(F.lit("Code: "), F.get(names, F.lit(0)))), F.get(spoken, F.lit(0)), fallback)


# The metadata keys that may hold a title.
TITLE_KEYS = ("title", "name", "subject", "topic")


def titled_by_metadata(metadata: Column, otherwise: Column) -> Column:
    """The first of the title keys in a JSON object that holds a string of 4 to 99 characters, else the other title."""
    m = F.try_parse_json(metadata)
    held = lambda k: F.when(F.schema_of_variant(F.try_variant_get(m, f"$.{k}", "variant")) == "STRING", F.try_variant_get(m, f"$.{k}", "string"))
    return F.coalesce(*[F.when((F.length(held(k)) > 3) & (F.length(held(k)) < 100), held(k)) for k in TITLE_KEYS], otherwise)


def fallback_summary(text: Column, chars: int = 200) -> Column:
    return F.concat(F.left(text, F.lit(chars)), F.lit("..."))


def fallback_title(text: Column) -> Column:
    return F.left(F.get(F.filter(F.transform(F.split(text, "\n"), strip), lambda x: F.length(x) > 20), F.lit(0)), F.lit(80))


def iso_timestamp(value: Column) -> Column:
    """Strings pass; numbers in text of 13 digits are milliseconds."""
    return F.when(value.rlike(r"^\d{13}$"), F.date_format(F.timestamp_millis(value.cast("long")), "yyyy-MM-dd'T'HH:mm:ss")).otherwise(F.nullif(value, F.lit("")))


def iso_of_variant(value: Column) -> Column:
    """A VARIANT's time: strings as iso_timestamp(), numbers are milliseconds since 1970, with microseconds shown where there are any."""
    kind = F.schema_of_variant(value)
    ms = F.when(kind.rlike("^(BIGINT|DOUBLE|DECIMAL|INT|FLOAT)"), F.try_variant_get(value, "$", "double"))
    at = F.timestamp_micros(F.round(ms * 1000).cast("long"))
    shown = F.when(F.round(ms * 1000) % 1_000_000 == 0, F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss")).otherwise(F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"))
    return F.coalesce(shown, iso_timestamp(F.when(kind == "STRING", F.try_variant_get(value, "$", "string"))))


def display_date(value: Column) -> Column:
    return F.coalesce(F.when(value.rlike(r"^\d{13}$"), F.date_format(F.timestamp_millis(value.cast("long")), "yyyy-MM-dd")).otherwise(F.left(F.nullif(value, F.lit("")), F.lit(10))), F.lit("unknown"))


def score_band(score: Column) -> Column:
    return F.when(score > 5, "high").when(score > 2, "mid").otherwise("low")

