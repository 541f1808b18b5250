"""Filter audit and sketches against brute force on small tables with awkward rows."""

import hashlib
import random
import re
from collections import Counter
from itertools import permutations

import pytest

from tessera.llm import filter_audit, sketches

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, mask int, id string, n int"
LABELS = "doc_id long, quality int, toxic int, id string"


def documents(spark, rows, parts=3):
    """Rows of (doc_id, text, source), with further columns whose names clash with the operators' own."""
    return spark.createDataFrame([(i, t, "en", s, 1, 7, "x", 2) for i, t, s in rows], SCHEMA).repartition(parts)


def awkward():
    rng = random.Random(5)
    word = lambda: rng.choice(["Alpha", "beta", "GAMMA", "délta", "e#f", "x", "好"])
    texts = [None, "", "  \n", "A", "a b", "Up$ down", "w " * 300, " ".join(f"w{i}" for i in range(250)), "CAPS " * 210, " ".join(word() for _ in range(400)), "one two three four", "one two three four five six"]
    rows = [(i, t, f"s{i % 3}" if i % 5 else None) for i, t in enumerate(texts)]
    rows += [(100 + i, texts[i % len(texts)], f"s{i % 4}") for i in range(40)]
    return rows + [(None, "a b", "s1"), (None, None, "s2"), (4, "a b", "s1"), (4, "a b", "s2"), (4, "a b", "s2"), (105, "other text", "s9")]


def audit_by_hand(rows, labels):
    good, toxic = {i for i, q, _ in labels if q == 1 and i is not None}, {i for i, _, t in labels if t == 1 and i is not None}
    first, docs = {}, []
    for i, t, _ in rows:
        if i is not None:
            first[t or ""] = min(i, first.get(t or "", i))
    for i, t, s in rows:
        t = t or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        bad = set()
        bad |= {"A"} if len(w) < 200 else set()
        bad |= {"B"} if 100 * len(set(w)) < 50 * len(w) else set()
        bad |= {"C"} if 100 * len(re.findall("[A-Z]", t)) > 2 * len(t) else set()
        bad |= {"D"} if re.search("[#$%&*|]", t) else set()
        bad |= {"E"} if i is not None and first[t] < i else set()
        docs.append((s or "", bad, i in good, i in toxic))
    out = {}
    for part in {d[0] for d in docs}:
        mine, removed_by = [d for d in docs if d[0] == part], Counter()
        for order in map("".join, permutations("ABCDE")):
            left = mine
            for step, f in enumerate(order, 1):
                gone = [d for d in left if f in d[1]]
                earlier = [d for d in mine if f in d[1] and d not in left]
                seen = set(order[: step - 1])
                assert len(earlier) == sum(f in d[1] and bool(d[1] & seen) for d in mine)
                left = [d for d in left if f not in d[1]]
                removed_by[f] += len(gone)
                out[part, order, step] = [len(left), len(gone), len(earlier), sum(d[1] == {f} for d in mine), sum(d[2] for d in gone), sum(d[3] for d in gone)]
        for (p, order, step), v in out.items():
            if p == part:
                v.append(removed_by[order[step - 1]])
    return out


@pytest.mark.parametrize("parts", [1, 5])
def test_audit_counts_as_a_simulation_of_all_orders(spark, parts):
    rows = awkward()
    labels = [(i, i % 2, i % 3 == 0) for i in range(0, 120, 3)] + [(3, 1, 1), (3, 0, 0), (None, 1, 1), (6, None, None), (999, 1, 1)]
    table = spark.createDataFrame([(i, q, None if t is None else int(t), "clash") for i, q, t in labels], LABELS)
    got = {(r.part, r.filter_order, r.step): [r.kept, r.removed, r.redundant, r.unique_fails, r.good_lost, r.toxic_lost, r.shapley] for r in filter_audit.audit(documents(spark, rows, parts), table).collect()}
    want = audit_by_hand(rows, labels)
    assert len(got) == 600 * 6
    assert got == want


def test_audit_of_nothing_and_of_one_text_everywhere(spark):
    none = spark.createDataFrame([], LABELS)
    assert filter_audit.audit(documents(spark, []), none).count() == 0
    one = filter_audit.audit(documents(spark, [(i, "same text", "a" if i else None) for i in range(3000)], 7), none)
    r = one.where("filter_order = 'EABCD' and step = 1").orderBy("part").collect()
    assert [(x.part, x.kept, x.removed) for x in r] == [("", 1, 0), ("a", 0, 2999)]
    assert one.count() == 1200


def test_lattice_has_80_edges_and_600_steps(spark):
    edges = filter_audit.edge_counts(spark.createDataFrame([("p", 0, 1, 0, 0)], "part string, mask int, n long, good long, toxic long"))
    assert edges.count() == 80
    assert edges.selectExpr("sum(orders)").first()[0] == 5 * 120
    steps = filter_audit.paths(spark)
    assert steps.count() == 600 and steps.select("filter_order").distinct().count() == 120
    assert steps.join(edges, ["applied", "next"]).groupBy("applied", "next", "orders").count().where("count <> orders").count() == 0


def shingles(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", text)
    return {" ".join(w[i : i + 5]) for i in range(max(len(w) - 4, 1))} if w else set()


def lowest(parts, k=256):
    return sorted({hashlib.md5(s.encode()).hexdigest()[:16] for s in parts})[:k]


def near(a, b, k=256):
    u = sorted(set(a) | set(b))[:k]
    return len(set(u) & set(a) & set(b)) / len(u) if u else 1.0


def fingerprints_by_hand(rows, k=256):
    rows = sorted(((i, t or "") for i, t, _ in rows), key=lambda r: (r[0] is not None, r[0] or 0, hashlib.md5(r[1].encode()).hexdigest()))
    out = []
    for at, (i, t) in enumerate(rows):
        following = rows[(at + 1) % len(rows)][1]
        cut = len(t) // 4
        edited = t[: len(t) - cut] + following[:cut]
        a, b, c = (lowest(shingles(x), k) for x in (t, edited, following))
        out.append((i, len(t), hashlib.sha256(edited.encode()).hexdigest(), "".join(a), "".join(b), round(near(a, b, k), 9), round(near(a, c, k), 9)))
    return out


def fingerprint_rows(df):
    return [(r.doc_id, r.n_chars, r.edited_sha256, r.fingerprint, r.edited_fingerprint, round(r.near_edited, 9), round(r.near_next, 9)) for r in df.collect()]


@pytest.mark.parametrize("parts", [1, 6])
def test_fingerprints_as_by_hand(spark, parts):
    rng = random.Random(parts)
    rows = awkward() + [(500 + 3 * i, " ".join(rng.choice("abcdefghij") + rng.choice("klmno") for _ in range(rng.randrange(900))), "s") for i in range(30)]
    rows += [(777, " ".join(f"w{rng.random()}" for _ in range(30000)), "s"), (778, "x" * 50000, "s")]
    key = lambda r: (r[0] is not None, r[0] or 0, *r[1:])
    assert sorted(fingerprint_rows(sketches.fingerprints(documents(spark, rows, parts))), key=key) == sorted(fingerprints_by_hand(rows), key=key)


def test_fingerprints_of_few_rows_and_many_copies(spark):
    assert sketches.fingerprints(documents(spark, [])).count() == 0
    alone = fingerprint_rows(sketches.fingerprints(documents(spark, [(1, "a b c d e f g h i j", "s")])))
    assert alone == fingerprints_by_hand([(1, "a b c d e f g h i j", "s")])
    rows = [(i % 2, "the same words in each of these rows", "s") for i in range(2000)]
    got = sketches.fingerprints(documents(spark, rows, 8))
    assert got.count() == 2000 and got.where("near_next = 1.0").count() == 2000
    assert got.select("fingerprint").distinct().count() == 1


def test_sketches_merge_to_that_of_the_whole(spark):
    rng = random.Random(1)
    words = [f"w{rng.randrange(5000)}" for _ in range(6000)]
    pieces = [(g, " ".join(words[at : at + 504])) for g in "a" for at in range(0, len(words) - 4, 500)] + [("b", "few words"), ("b", None)]
    df = spark.createDataFrame(pieces, "g string, text string").repartition(5).select("g", sketches.sketch(sketches.F.col("text")).alias("sketch"))
    merged = {r.g: r.sketch for r in sketches.merge_groups(df, ["g"]).collect()}
    assert merged["a"] == lowest(shingles(" ".join(words)))
    assert merged["b"] == lowest({"few words"})


def test_estimates_are_near_the_truth(spark):
    rng = random.Random(2)
    pool = [f"w{i}" for i in range(20000)]
    a = [rng.choice(pool) for _ in range(8000)]
    rows = [(" ".join(a), " ".join(a[: 8000 - n] + [rng.choice(pool) for _ in range(n)])) for n in (0, 800, 2400, 6000)] + [(" ".join(a), " ".join(a[:4000]))]
    df = spark.createDataFrame(rows, "a string, b string").select("a", "b", *[sketches.sketch(sketches.F.col(c)).alias(f"s{c}") for c in "ab"])
    sa, sb = sketches.F.col("sa"), sketches.F.col("sb")
    for r in df.select("a", "b", sketches.resemblance(sa, sb).alias("j"), sketches.containment(sb, sa).alias("c"), sketches.distinct_shingles(sa).alias("n")).collect():
        x, y = shingles(r.a), shingles(r.b)
        assert abs(r.j - len(x & y) / len(x | y)) < 0.1
        assert abs(r.c - len(x & y) / len(y)) < 0.2
        assert abs(r.n / len(x) - 1) < 0.2


def test_native_plans_hold_no_python(spark):
    plan = sketches.fingerprints(documents(spark, awkward()))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan
    assert plan.count("Exchange") == 2  # that of documents() above, and one of the texts
