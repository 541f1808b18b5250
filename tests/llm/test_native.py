"""PII pseudonyms, decontamination, mixing, top-k and the pipeline."""

import hashlib
import random
import re
from collections import Counter, defaultdict
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.llm import decontaminate, mixing, pii, topk
from tessera.llm.common import Tables

DOCS = "doc_id long, text string"
FOLD = {i: i + 32 for i in range(65, 91)}

# -- PII --------------------------------------------------------------------------------------------------

TEXTS = [
    "call +1 (319) 555-5132 now, card 4337166598464399 4111111111111112 x",
    "mail hsr.29@mail5.example.com the 17.252.227.210 999.1.1.1",
    "born 1984-02-29, 12/31/1999 31/12/1999 03.04.1950 1850-01-01 2023-02-30",
    "ssn 123-45-6789 000-12-3456; IBAN GB82 WEST 1234 5698 7654 32, DE89370400440532013000 GB82WEST12345698765433",
    "4337-1665-9846-4399 4337 1665 9846 4399 (319) 555-5132 319-555-5132 joe@no-digits.org",
    "nothing here 12 v3.0",
    "",
    None,
]


def luhn(s):
    d = [int(c) for c in re.sub(r"\D", "", s)]
    return sum(sum(divmod(x * (1 + i % 2), 10)) for i, x in enumerate(reversed(d))) % 10 == 0


def test_pseudonyms_keep_formats_links_and_can_be_inverted(spark):
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate(TEXTS)], DOCS + ", n_found string")
    made = pii.pseudonymise(df, "key")
    got = {r.doc_id: r for r in made.collect()}
    back = {r.doc_id: r.text for r in pii.pseudonymise(made, "key", inverse=True).collect()}
    assert back == dict(enumerate(TEXTS))
    for i, t in enumerate(TEXTS):
        if t:
            assert re.sub("[a-z]", "a", re.sub(r"\d", "9", got[i].text)).replace("99.", "9.").count("@") == t.count("@")
    assert [got[i].n_found for i in range(8)] == [2, 2, 4, 3, 5, 0, 0, 0]
    card, phone = re.search(r"card (\d+)", got[0].text)[1], got[0].text[5:22]
    assert luhn(card) and card != "4337166598464399" and got[0].text.endswith("4111111111111112 x")
    assert re.sub(r"\D", "", got[4].text[:19]) == card and phone[3:] in got[4].text  # linked across documents and spellings
    assert got[2].text.endswith("1850-01-01 2023-02-30") and "999.1.1.1" in got[1].text and "000-12-3456" in got[3].text
    other = {r.doc_id: r.text for r in pii.pseudonymise(df, "other key").collect()}
    assert other[0] != got[0].text
    assert pii.pseudonymise(df.limit(0), "key").count() == 0


def test_pairs_are_permuted(spark):
    sizes = (17, 23)
    df = spark.range(17 * 23).select(pii.permute_pair(F.floor(F.col("id") / 23), F.col("id") % 23, sizes, "k", "t").alias("p"))
    assert len({(r.p.x, r.p.y) for r in df.collect()}) == 17 * 23


def test_short_strings_are_permuted(spark):
    df = spark.range(1000).select(pii.permute_text(F.lpad(F.col("id").cast("string"), 3, "0"), "k", "t").alias("p"))
    assert len({r.p for r in df.collect()}) == 1000


# -- decontamination ----------------------------------------------------------------------------------------


def words(t):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate(FOLD))


def brute_contamination(docs, items, window=10):
    out = []
    for i, t in docs:
        w, hit, found = words(t), set(), set()
        for j, x in items:
            v = words(x)
            n = min(len(v), window)
            for s in range(len(v) - n + 1) if v else ():
                for p in range(len(w) - n + 1):
                    if w[p : p + n] == v[s : s + n]:
                        hit |= set(range(p, p + n))
                        if j is not None:
                            found.add(str(j))
        out.append((str(i), len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit)))
    return sorted(out)


def test_contamination_is_the_brute_force_one(spark):
    rng = random.Random(4)
    vocabulary = ["the", "of", "É", "é", "ab", "Cd", "x1", "ß"]
    text = lambda n: rng.choice([" ", ", ", "\n"]).join(rng.choice(vocabulary) for _ in range(n))
    items = [(i, text(rng.randint(8, 25))) for i in range(12)] + [(50, "Ab"), (51, "x1 the ab"), (52, ""), (53, None), (None, text(12)), (54, "--"), (0, text(12)), (60, "the " * 14)]
    docs = [(i, " ".join([text(rng.randint(0, 30)), rng.choice(items)[1] or "", text(5)])) for i in range(60)]
    docs += [(100, None), (101, ""), (102, "the " * 40), (None, items[0][1]), (3, docs[3][1]), (103, items[1][1].upper())]
    df = spark.createDataFrame([(*d, 1) for d in docs], DOCS + ", term int").repartition(3)
    bench = spark.createDataFrame([(*x, "p") for x in items], "item_id long, text string, pos string")
    got = decontaminate.contamination(df, bench).drop("h").collect()
    assert sorted((str(r.doc_id), r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) for r in got) == brute_contamination(docs, items)


def test_contamination_of_one_word_repeated(spark):
    docs = [(1, "the " * 200_000), (2, "The, " * 9), (3, "the " * 11 + "end"), (1, "the " * 200_000)]
    items = spark.createDataFrame([("a", "the " * 30), ("b", "the " * 400), ("c", "the end"), ("d", "the")], "item_id string, text string")
    got = decontaminate.contamination(spark.createDataFrame(docs, DOCS), items).collect()
    assert sorted((r.doc_id, r.n_words, r.n_hit, r.n_items) for r in got) == [(1, 200_000, 200_000, 3), (1, 200_000, 200_000, 3), (2, 9, 9, 1), (3, 12, 12, 4)]
    assert [[(s.at, s.end) for s in r.spans] for r in got if r.doc_id == 2] == [[(i, i + 1) for i in range(9)]]


def test_only_the_rarest_terms_have_postings(spark):
    from tessera.llm.common import Tables

    docs = spark.createDataFrame([(i, "a b c d e f g h i j") for i in range(20)] + [(99, "x a b c d e f g h i j")], DOCS)
    windows = decontaminate.windows_of(decontaminate.item_words(spark.createDataFrame([(1, "x a b c d e f g h i j")], "item_id long, text string"), "item_id", "text"), 10)
    tables = Tables(spark, "test")
    counts = tables.keep(decontaminate.term_counts(docs, windows.select(F.explode("words").alias("w")).select(F.xxhash64("w").alias("term")).distinct()))
    rarest = decontaminate.rarest_terms(windows, counts).collect()
    assert counts.count() == 11 and len(rarest) == 2 and {r.width for r in rarest} == {10}
    assert len({t for r in rarest for t in (r.term0, r.term1)}) <= 4


def test_contamination_of_empty_tables(spark):
    docs, bench = spark.createDataFrame([(1, "a b c")], DOCS), spark.createDataFrame([], "item_id long, text string")
    assert [(r.n_words, r.contaminated) for r in decontaminate.contamination(docs, bench).collect()] == [(3, False)]
    assert decontaminate.contamination(docs.limit(0), bench).count() == 0


def test_proximity_matches(spark):
    tables = Tables(spark, "test")
    docs = spark.createDataFrame([(1, "red x x fox"), (2, "red x x x x x fox"), (3, "fox red")], DOCS)
    items = tables.keep(decontaminate.item_words(spark.createDataFrame([(1, "red fox")], "item_id long, text string"), "item_id", "text"))
    index = decontaminate.build_index(docs, tables.keep(decontaminate.vocabulary_of(items)), tables)
    assert {r.id for r in decontaminate.proximity_matches(items, index, within=3).collect()} == {1, 3}


# -- mixing ---------------------------------------------------------------------------------------------------------


def brute_targets(sizes):
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    left, open_, out = 1.5 * sum(sizes.values()), set(order), {}
    while open_:
        level = left / sum(weight[s] for s in open_)
        over = [s for s in open_ if level * weight[s] > 2 * sizes[s]]
        if not over:
            return out | {s: level * weight[s] for s in open_}
        for s in over:
            out[s] = 2.0 * sizes[s]
            left -= out[s]
            open_.remove(s)
    return out


def test_mix_meets_its_targets(spark):
    rng = random.Random(6)
    rows = [(i, "w " * rng.choice([0, 1, 5, 40, 80, 300]), rng.choice(["a", "a", "a", "b", "c", "d", "e", None])) for i in range(1500)]
    rows += [(5000, None, "a"), (5001, "x", "empty only"), (3, rows[3][1], rows[3][2])]
    df = spark.createDataFrame([(*r, 9) for r in rows], DOCS + ", source string, size int")
    got = mixing.mix(df, shard=64).collect()
    sizes, taken = Counter(), Counter()
    for _, t, s in rows:
        sizes[s] += len((t or "").split())
    want = brute_targets(sizes)
    assert len(got) == len(rows)
    for r in got:
        taken[r.source] += r.taken
        assert r.taken == r.copies * r["size"] <= 2 * r["size"] and r.source_size == sizes[r.source]
        assert r.target == pytest.approx(want[r.source])
    for s, t in want.items():
        assert abs(taken[s] - t) <= max(3, 0.005 * t), s
    again = mixing.mix(df.repartition(7), shard=64).collect()
    assert sorted((str(r.doc_id), r.taken) for r in got) == sorted((str(r.doc_id), r.taken) for r in again)
    assert mixing.mix(df.limit(0)).count() == 0


def test_flight_keeps_sums():
    rng = np.random.default_rng(0)
    for _ in range(50):
        n = int(rng.integers(1, 60))
        p, s = rng.random(n), rng.integers(1, 50, n)
        q = mixing.flight(p, s, rng)
        assert q.sum() == pytest.approx(p.sum(), abs=1e-6) and (q * s).sum() == pytest.approx((p * s).sum(), abs=1e-4)
        assert ((q > 0) & (q < 1)).sum() <= 2 and (q >= 0).all() and (q <= 1).all()


def test_flight_keeps_inclusion_probabilities():
    s = np.array([5, 9, 2, 7, 7, 3, 4, 8, 1, 6])
    total = sum(mixing.flight(np.full(10, 0.3), s, np.random.default_rng(i)) for i in range(3000)) / 3000
    assert np.abs(total - 0.3).max() < 0.04


# -- top-k -------------------------------------------------------------------------------------------------------------


def test_top_k_is_exhaustive(spark, monkeypatch):
    rng = np.random.default_rng(1)
    monkeypatch.setattr(topk, "BLOCK", 16)
    rows = [(int(i), [float(x) for x in rng.integers(-3, 4, 6) / 4]) for i in range(300)]
    rows += [(1000 + i, rows[7][1]) for i in range(20)] + [(400, None), (450, [1.0, None]), (500, [float("nan")]), (550, [float("inf")]), (600, [0.5]), (650, []), (None, [1.0]), (5, rows[9][1])]
    df = spark.createDataFrame([(*r, 1) for r in rows], "vec_id long, embedding array<float>, score int")
    usable = [(i, [int(np.floor(256 * np.float64(np.float32(x)))) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    want = []
    for qid in sorted({i for i, _ in usable if i % 50 == 0}):
        q = min(v for i, v in usable if i == qid)
        scored = sorted((-sum(a * b for a, b in zip(q, v, strict=False)), i) for i, v in usable if i != qid)[:5]
        want += [(qid, r + 1, i, -s) for r, (s, i) in enumerate(scored)]
    for block in (4096, 3):
        got = topk.exact_top_k(df.repartition(5), lambda c: c % 50 == 0, queries_per_block=block).collect()
        assert sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in got) == sorted(want)
    few = topk.exact_top_k(df.where("vec_id in (0, 1, 2)"), lambda c: c % 50 == 0).collect()
    assert len(few) == 2
    twice = spark.createDataFrame([(50, [1.0, 2.0]), (50, [None, 2.0]), (50, [float("nan"), 0.0]), (1, [1.0, 1.0]), (2, [2.0, 0.0]), (100, [None, 1.0])], "vec_id long, embedding array<double>")
    again = topk.exact_top_k(twice, lambda c: c % 50 == 0).orderBy("rank").collect()  # the usable vector of a repeated id asks
    assert [(r.query_id, r.vec_id, r.score) for r in again] == [(50, 1, 3 * 65536), (50, 2, 2 * 65536)]
    assert topk.exact_top_k(df.limit(0), lambda c: c % 50 == 0).count() == 0


# -- pipeline -------------------------------------------------------------------------------------------------------------

SMALL = Path("/root/testdata/sf0.001")


@pytest.mark.skipif(not SMALL.is_dir(), reason="no test tables")
def test_pipeline_stages(spark):
    import corpus_pipeline as C
    from tests.llm.test_dedup import brute_lines

    tables = Tables(spark, "test")
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    steps = [docs]
    for name, stage in C.STAGES:
        steps.append(tables.keep(stage(spark, steps[-1], str(SMALL))))
        assert name == "mix" or steps[-1].columns == docs.columns
    start, good, lines, near, clean, mixed = ([r.asDict() for r in s.collect()] for s in steps)
    by = lambda rows: {r["doc_id"]: r for r in rows}
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{SMALL}/labels.parquet").collect()}
    kept = by(good)
    right = [(i in kept) == bool(q) for i, q in labels.items()]
    assert sum(right) / len(right) > 0.9
    want = brute_lines([(r["doc_id"], r["text"]) for r in good])
    assert all(by(lines)[r["doc_id"]]["text"] == want[r["doc_id"], r["text"]][3] for r in good) and len(lines) == len(good)
    from tessera.llm.simhash import fingerprint

    prints = {r["doc_id"]: fingerprint(r["text"].encode()) for r in lines}
    left = {r["doc_id"] for r in near}
    for i, p in prints.items():
        close = [j for j, o in prints.items() if (p ^ o).bit_count() <= 3]
        assert (i in left) == (i == min(close)) or len(close) > 1
    bench = [(r.item_id, r.text) for r in spark.read.parquet(f"{SMALL}/benchmark.parquet").collect()]
    dirty = {i for i, *_, hit in brute_contamination([(r["doc_id"], r["text"]) for r in near], bench) if hit}
    assert {str(r["doc_id"]) for r in clean} == {str(r["doc_id"]) for r in near} - dirty
    sizes, taken = defaultdict(int), defaultdict(int)
    for r in clean:
        sizes[r["source"]] += len(r["text"].encode().split())
    for r in mixed:
        taken[r["source"]] += r["taken"]
        assert r["copies"] in (1, 2) and by(clean)[r["doc_id"]]["text"] == r["text"]
    for s, t in brute_targets(sizes).items():
        largest = max(len(r["text"].encode().split()) for r in clean if r["source"] == s)
        assert abs(taken[s] - t) <= max(20, 0.02 * t, largest / 2)  # ten documents a source


def test_near_keeps_one_row_of_each_group(spark):
    import corpus_pipeline

    texts = [" ".join(f"t{n}x{j}" for j in range(80)) for n in range(5)]
    rows = [(1, texts[0]), (2, texts[0]), (3, texts[1]), (3, texts[2]), (None, texts[3]), (None, texts[3]), (None, texts[4]), (None, texts[1])]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    got = sorted((str(r.doc_id), r.text) for r in corpus_pipeline.near(spark, docs, "").collect())
    assert got == sorted([("1", texts[0]), ("3", texts[1]), ("3", texts[2]), ("None", texts[3]), ("None", texts[4])])
