"""PII: format-preserving Feistel pseudonyms, in DataFrame operations only.

Found and validated values are permuted under a key within their own format, so equal values stay equal
(and linked) across documents and the key's holder can invert them:

- e-mail addresses: letters and digits of the local part and of the domain before its last label;
- payment cards (13-19 digits, Luhn): all digits but the first; the last is the check digit again;
- IBANs (mod 97): letters and digits after the check digits, which are computed anew;
- telephone numbers (7-15 digits; with a country code, brackets or separators): the last 10 digits at most;
- US social security numbers: among valid ones; IPv4 addresses: among all;
- dates of 1900-2099 (YYYY-MM-DD, YYYY/MM/DD, MM/DD/YYYY, DD/MM/YYYY, DD.MM.YYYY): among these days, in the same form.

Strings go through a Feistel network that adds keyed digits position by position (mod 10 or 26 by the kind of
character, which stays); pairs of numbers through one that adds mod the size of each half, so no value outside the
domain arises. Punctuation and spacing stay, so two spellings of one number are pseudonymised alike.
DD/MM dates with a day up to 12 are read as MM/DD; those with a later day are permuted among each other, so these two forms aren't linked to one another. Months and days of one digit may come back with two.

Cases: null stays null; values that fail validation stay; every occurrence is replaced; repeated rows are
treated alike; texts of any length are processed whole; other columns pass through (n_found is replaced); an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ROUNDS = 10
EMAIL = r"[A-Za-z0-9][A-Za-z0-9._%+-]*@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,24}"
IBAN = r"[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?"
DATE = r"\d{4}(?<d1>[-/])\d{2}\k<d1>\d{2}|\d{1,2}(?<d2>[/.])\d{1,2}\k<d2>\d{4}"
IPV4 = r"\d{1,3}(?:\.\d{1,3}){3}"
CARD = r"\d{4}(?<c1>[ -])\d{4}\k<c1>\d{4}\k<c1>\d{4}|\d{4}(?<c2>[ -])\d{6}\k<c2>\d{4,5}|\d{13,19}"
SSN = r"\d{3}-\d{2}-\d{4}"
PHONE = r"\+\d{1,3}[ .-]?(?:\(\d{1,4}\)|\d{1,4})(?:[ .-]\d{2,4}){1,4}|\+\d{8,15}|\(\d{3}\) ?\d{3}[ .-]\d{4}|\d{3}(?<p1>[.-])\d{3}\k<p1>\d{4}"
ANY = rf"(?<![A-Za-z0-9])(?:{EMAIL}|{IBAN}|{DATE}|{IPV4}|{CARD}|{SSN}|{PHONE})(?![A-Za-z0-9])"
KINDS = ("email", "iban", "date", "ipv4", "card", "ssn", "phone")
#: 1900-01-01 to 2099-12-31 are 73049 = 17 * 4297 days.
FIRST_DAY, DAYS = "1900-01-01", (17, 4297)


def let(value: Column, then) -> Column:
    """then(value), with value evaluated once: a lambda's variable, where an expression would be evaluated at each use."""
    return F.transform(F.array(value), then)[0]


def full(m: Column, pattern: str) -> Column:
    return m.rlike(f"^(?:{pattern})$")


def keyed(key: str, *parts: Column) -> Column:
    """A keyed digest: 64 hexadecimal digits."""
    inner = F.sha2(F.concat_ws("|", F.lit(key), *[p.cast("string") for p in parts]), 256)
    return F.sha2(F.concat_ws("|", F.lit(key), inner), 256)


def number(hexadecimal: Column) -> Column:
    return F.conv(hexadecimal, 16, 10).cast("long")


def permute_text(s: Column, key: str, tag: str, inverse: bool = False) -> Column:
    """Permutes strings of one format: digits among digits, A-Z among A-Z, a-z among a-z, others fixed."""
    return let(s, lambda v: _permute_text(v, key, tag, inverse))


def _permute_text(s: Column, key: str, tag: str, inverse: bool) -> Column:
    half = F.floor(F.length(s) / 2).cast("int")
    sign = -1 if inverse else 1

    def moved(part: Column, other: Column, i: Column) -> Column:
        def one(j: Column) -> Column:
            c = F.substring(part, j, F.lit(1))
            at = j - 1
            by = sign * number(F.substring(keyed(key, F.lit(tag), i, F.floor(at / 16), other), 1 + 4 * F.pmod(at, F.lit(16)).cast("int"), F.lit(4)))
            turn = lambda first, n: F.char(F.pmod(F.ascii(c) - first + by, F.lit(n)) + first)
            return F.when(c.rlike("[0-9]"), turn(48, 10)).when(c.rlike("[a-z]"), turn(97, 26)).when(c.rlike("[A-Z]"), turn(65, 26)).otherwise(c)

        return F.when(F.length(part) == 0, part).otherwise(F.array_join(F.transform(F.sequence(F.lit(1), F.length(part)), one), ""))

    def step(acc: Column, i: Column) -> Column:
        left = F.when(i % 2 == 0, moved(acc["l"], acc["r"], i)).otherwise(acc["l"])
        right = F.when(i % 2 == 1, moved(acc["r"], acc["l"], i)).otherwise(acc["r"])
        return F.struct(left.alias("l"), right.alias("r"))

    rounds = F.sequence(F.lit(ROUNDS - 1), F.lit(0)) if inverse else F.sequence(F.lit(0), F.lit(ROUNDS - 1))
    start = F.struct(F.substring(s, F.lit(1), half).alias("l"), F.substring(s, half + 1, F.length(s)).alias("r"))
    return F.aggregate(rounds, start, step, lambda a: F.concat(a["l"], a["r"]))


def permute_pair(x: Column, y: Column, sizes: tuple[int, int], key: str, tag: str, inverse: bool = False) -> Column:
    """Permutes pairs (x < sizes[0], y < sizes[1])."""
    sign = -1 if inverse else 1

    def step(acc: Column, i: Column) -> Column:
        draw = lambda of: sign * number(F.substring(keyed(key, F.lit(tag), i, of), 1, 12))
        a = F.when(i % 2 == 0, F.pmod(acc["x"] + draw(acc["y"]), F.lit(sizes[0]).cast("long"))).otherwise(acc["x"])
        b = F.when(i % 2 == 1, F.pmod(acc["y"] + draw(acc["x"]), F.lit(sizes[1]).cast("long"))).otherwise(acc["y"])
        return F.struct(a.alias("x"), b.alias("y"))

    rounds = F.sequence(F.lit(ROUNDS - 1), F.lit(0)) if inverse else F.sequence(F.lit(0), F.lit(ROUNDS - 1))
    return F.aggregate(rounds, F.struct(x.cast("long").alias("x"), y.cast("long").alias("y")), step)


def digits_of(m: Column) -> Column:
    return F.regexp_replace(m, r"\D", "")


def put_back(m: Column, pattern: str, chars: Column) -> Column:
    """m with its characters that match pattern replaced in turn by those of chars."""
    return let(chars, lambda c: _put_back(m, pattern, c))


def _put_back(m: Column, pattern: str, chars: Column) -> Column:
    return F.aggregate(F.split(m, ""), F.struct(F.lit("").alias("out"), F.lit(1).alias("at")), lambda a, c: F.when(c.rlike(pattern), F.struct(F.concat(a["out"], F.substring(chars, a["at"], F.lit(1))).alias("out"), (a["at"] + 1).alias("at"))).otherwise(F.struct(F.concat(a["out"], c).alias("out"), a["at"].alias("at"))), lambda a: a["out"])


def luhn_sum(digits: Column) -> Column:
    """Of digits whose last is the check digit."""
    return let(digits, _luhn_sum)


def _luhn_sum(digits: Column) -> Column:
    n = F.length(digits)

    def add(acc: Column, j: Column) -> Column:
        d = F.substring(digits, j, F.lit(1)).cast("int") * F.when((n - j) % 2 == 1, 2).otherwise(1)
        return (acc + d - F.when(d > 9, 9).otherwise(0)).cast("int")

    return F.aggregate(F.sequence(F.lit(1), n), F.lit(0), add)


def mod97(s: Column) -> Column:
    """Of an IBAN's characters, the first four moved to the end and letters counted from 10."""
    turned = F.concat(F.substring(s, F.lit(5), F.length(s)), F.substring(s, 1, 4))

    def add(acc: Column, c: Column) -> Column:
        v = F.when(c.rlike("[A-Z]"), F.ascii(c) - 55).otherwise(F.ascii(c) - 48)
        return F.pmod(acc * F.when(v > 9, 100).otherwise(10) + v, F.lit(97)).cast("int")

    return F.aggregate(F.filter(F.split(turned, ""), lambda c: c != ""), F.lit(0), add)


def day_number(day: Column) -> Column:
    return F.datediff(day, F.lit(FIRST_DAY).cast("date"))


def date_forms(m: Column) -> list[tuple[str, str]]:
    """(pattern, date format), the first that matches and parses counts."""
    return [(r"\d{4}-\d{2}-\d{2}", "yyyy-MM-dd"), (r"\d{4}/\d{2}/\d{2}", "yyyy/MM/dd"), (r"\d{2}/\d{2}/\d{4}", "MM/dd/yyyy"), (r"\d{2}/\d{2}/\d{4}", "dd/MM/yyyy"), (r"\d{2}\.\d{2}\.\d{4}", "dd.MM.yyyy"), (r"\d{1,2}/\d{1,2}/\d{4}", "M/d/yyyy"), (r"\d{1,2}/\d{1,2}/\d{4}", "d/M/yyyy"), (r"\d{1,2}\.\d{1,2}\.\d{4}", "d.M.yyyy")]


def valid_kind(m: Column) -> Column:
    """The kind of a candidate; null if it isn't valid."""
    digits, compact = digits_of(m), F.replace(m, F.lit(" "), F.lit(""))
    a = lambda at, n: F.substring(digits, at, n).cast("int")
    parsed = F.coalesce(*[F.when(full(m, p), F.try_to_timestamp(m, F.lit(f)).cast("date")) for p, f in date_forms(m)])
    octets = F.forall(F.split(m, r"\."), lambda x: x.cast("int") <= 255)
    return (
        F.when(m.contains("@"), F.when(full(m, EMAIL), "email"))
        .when(m.rlike("^[A-Z]"), F.when((F.length(compact) >= 15) & (F.length(compact) <= 34) & (mod97(compact) == 1), "iban"))
        .when(full(m, DATE), F.when(day_number(parsed).between(0, DAYS[0] * DAYS[1] - 1), "date"))
        .when(full(m, IPV4), F.when(octets, "ipv4"))
        .when(full(m, SSN), F.when((a(1, 3) > 0) & (a(1, 3) != 666) & (a(1, 3) < 900) & (a(4, 2) > 0) & (a(6, 4) > 0), "ssn"))
        .when(full(m, CARD), F.when(F.pmod(luhn_sum(digits), F.lit(10)) == 0, "card"))
        .when(F.length(digits).between(7, 15), "phone")
    )


def pseudonym(m: Column, kind: Column, key: str, inverse: bool = False) -> Column:
    """The value that stands for m (or, inverted, that m stands for)."""
    go = lambda s, tag: permute_text(s, key, tag, inverse)
    rest_of = lambda s, at: F.substring(s, F.lit(at), F.length(s))
    pad = lambda c, n: F.lpad(c.cast("long").cast("string"), n, "0")

    def email() -> Column:
        return let(F.regexp_extract(m, r"\.[A-Za-z]+$", 0), lambda last: F.concat(go(F.substring(m, F.lit(1), F.length(m) - F.length(last)), "email"), last))

    def card(d: Column) -> Column:
        body = F.concat(F.substring(d, 1, 1), go(F.substring(d, F.lit(2), F.length(d) - 2), "card"))
        check = lambda b: F.pmod(10 - F.pmod(luhn_sum(F.concat(b, F.lit("0"))), F.lit(10)), F.lit(10)).cast("string")
        return put_back(m, "[0-9]", let(body, lambda b: F.concat(b, check(b))))

    def iban(c: Column) -> Column:
        land = F.substring(c, 1, 2)
        whole = lambda a: F.concat(land, F.lpad((98 - mod97(F.concat(land, F.lit("00"), a))).cast("string"), 2, "0"), a)
        return put_back(m, "[A-Z0-9]", let(go(rest_of(c, 5), "iban"), whole))

    def phone(d: Column) -> Column:
        keep = F.greatest(F.length(d) - 10, F.lit(0))
        return put_back(m, "[0-9]", F.concat(F.substring(d, F.lit(1), keep), go(F.substring(d, keep + 1, F.length(d)), "phone")))

    def ssn(d: Column) -> Column:
        area, group, serial = (F.substring(d, *at).cast("int") for at in ((1, 3), (4, 2), (6, 4)))
        pair = permute_pair(area - 1 - F.when(area > 666, 1).otherwise(0), (group - 1) * 9999 + serial - 1, (898, 99 * 9999), key, "ssn", inverse)
        number = lambda p: p["x"] + 1 + F.when(p["x"] + 1 >= 666, 1).otherwise(0)
        return let(pair, lambda p: F.concat_ws("-", pad(number(p), 3), pad(F.floor(p["y"] / 9999) + 1, 2), pad(F.pmod(p["y"], F.lit(9999)) + 1, 4)))

    def ip(o: Column) -> Column:
        pair = permute_pair(o[0].cast("long") * 256 + o[1].cast("long"), o[2].cast("long") * 256 + o[3].cast("long"), (65536, 65536), key, "ipv4", inverse)
        return let(pair, lambda p: F.concat_ws(".", F.floor(p["x"] / 256), F.pmod(p["x"], F.lit(256)), F.floor(p["y"] / 256), F.pmod(p["y"], F.lit(256))))

    def dated(pattern: str, form: str) -> Column:
        day_of = lambda p: F.date_add(F.lit(FIRST_DAY).cast("date"), (p["x"] * DAYS[1] + p["y"]).cast("int"))
        turn = lambda x, y: permute_pair(x, y, DAYS, key, "date", inverse)

        def moved(n: Column) -> Column:
            pair = turn(F.floor(n / DAYS[1]), F.pmod(n, F.lit(DAYS[1])))
            if form in ("dd/MM/yyyy", "d/M/yyyy"):  # on to the next day that can't be read as MM/DD either
                pair = F.aggregate(F.sequence(F.lit(1), F.lit(64)), pair, lambda p, _: F.when(F.dayofmonth(day_of(p)) > 12, p).otherwise(turn(p["x"], p["y"])))
            return let(pair, lambda p: F.date_format(day_of(p), form))

        day = F.try_to_timestamp(m, F.lit(form)).cast("date")
        return F.when(full(m, pattern) & day.isNotNull(), let(day_number(day), moved))

    digits, compact = digits_of(m), F.replace(m, F.lit(" "), F.lit(""))
    values = {"email": email(), "iban": let(compact, iban), "date": F.coalesce(*[dated(p, f) for p, f in date_forms(m)]), "ipv4": let(F.split(m, r"\."), ip), "card": let(digits, card), "ssn": let(digits, ssn), "phone": let(digits, phone)}
    out = F.when(kind.isNull(), m)
    for k in KINDS:
        out = out.when(kind == k, values[k])
    return out


def pseudonymise(docs: DataFrame, key: str, *, text_col: str = "text", inverse: bool = False) -> DataFrame:
    """docs with the text pseudonymised and n_found, the number of values replaced, appended."""
    text = F.col(text_col)
    values = F.transform(F.regexp_extract_all(text, F.lit(ANY), F.lit(0)), lambda m: F.struct(m.alias("m"), valid_kind(m).alias("kind")))
    new = lambda vs: F.transform(vs, lambda v: F.struct(v["kind"].alias("kind"), pseudonym(v["m"], v["kind"], key, inverse).alias("new")))
    joined = lambda vs: F.array_join(F.transform(F.split(text, ANY, -1), lambda g, i: F.concat(g, F.coalesce(F.get(vs, i)["new"], F.lit("")))), "")
    done = lambda vs: F.struct(joined(vs).alias("text"), F.size(F.filter(vs, lambda v: v["kind"].isNotNull())).cast("long").alias("n"))
    out = F.when(text.rlike("[0-9@]") & text.rlike(ANY), let(let(values, new), done)).otherwise(F.struct(text.alias("text"), F.lit(0).cast("long").alias("n")))
    src = docs.drop("n_found")
    # an explode keeps later projections from computing it again for each column
    once = src.withColumn("__out", F.array(out)).select(*[F.col(c) for c in src.columns if c != text_col], F.explode("__out").alias("__out"))
    return once.select(*[F.col("__out.text").alias(text_col) if c == text_col else F.col(c) for c in src.columns], F.col("__out.n").alias("n_found"))
