"""Substring, line and SimHash dedup against brute force."""

import ctypes
import random
import tracemalloc
from collections import defaultdict

import numpy as np
import pytest
import xxhash

from tessera.llm import line_dedup, simhash, substring_dedup
from tessera.llm.components import connected_components
from tessera.llm.common import Tables

DOCS = "doc_id long, text string"


class Groups:
    def __init__(self):
        self.up = {}

    def find(self, x):
        while self.up.setdefault(x, x) != x:
            x = self.up[x]
        return x

    def join(self, a, b):
        self.up[self.find(a)] = self.find(b)


# -- substring dedup --------------------------------------------------------------------------------


def edited(words, rng, every=25):
    out = list(words)
    for i in rng.sample(range(5, len(out) - 5), len(out) // every):
        out[i] = rng.choice(["other", out[i] + " more", ""])
    return out


def test_shared_passages_are_found_and_clean_documents_left_alone(spark):
    rng = random.Random(3)
    vocabulary = ["".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 7))) for _ in range(3000)]
    words = lambda n: [rng.choice(vocabulary) for _ in range(n)]
    passages, big = [words(60) for _ in range(6)], words(300)
    rows, holders = [], defaultdict(list)
    for i in range(120):
        text = words(rng.randint(0, 200))
        if i % 2 == 0:
            p = passages[i // 2 % 6]
            text = words(30) + (p if rng.random() < 0.5 else edited(p, rng)) + words(30)
            holders[i // 2 % 6].append(i)
        rows.append((i, " ".join(text).capitalize()))
    rows += [(200 + i, " ".join(big)) for i in range(30)] + [(300, " ".join(edited(big, rng))), (None, "a b"), (400, None), (401, ""), (402, " ".join(passages[0][:45]))]
    holders["big"] = [*range(200, 230), 300]
    df = spark.createDataFrame([(*r, "x") for r in rows], DOCS + ", seed string").repartition(3)
    groups, found = Groups(), set()
    for r in substring_dedup.shared_passages(df).collect():
        assert r.similarity >= 0.8 and max(r.n_words, r.other_end - r.other_start) >= 50 and r.doc_id > r.other_id
        groups.join(r.doc_id, r.other_id)
        found |= {r.doc_id, r.other_id}
    assert found == {i for g in holders.values() for i in g}
    assert all(len({groups.find(i) for i in g}) == 1 for g in holders.values())


def test_no_passages_in_an_empty_table(spark):
    assert substring_dedup.shared_passages(spark.createDataFrame([], DOCS)).count() == 0


def test_no_partner_is_dropped_for_stronger_ones(spark):
    words = [f"w{i}" for i in range(200)]
    edits = [[w if i % every else f"e{n}x{i}" for i, w in enumerate(words)] for n, every in enumerate((20, 25, 30, 35))]
    texts = [" ".join(w) for w in [*edits, words]]
    got = substring_dedup.shared_passages(spark.createDataFrame(list(enumerate(texts)), DOCS)).where("doc_id = 4")
    assert {r.other_id for r in got.collect()} == {0, 1, 2, 3}


def test_loose_chains_do_not_push_out_a_passage(spark):
    seeds = spark.createDataFrame([(9, x, of, x + d, 5) for of, d, xs in ((1, 0, range(0, 180, 20)), (2, 5, range(0, 180, 20)), (3, 9, (80, 90, 100))) for x in xs], "a long, x int, b long, y int, n int")
    got = substring_dedup.chained(seeds, k=5).collect()
    assert 3 in {r.b for r in got}


@pytest.mark.parametrize("parts", ["2", "7"])
def test_competing_fragments_hide_no_passage(spark, parts):
    """20 pairs share 80 words; other documents, before and between, hold only 12-word fragments of them."""
    rng = random.Random(4)
    fresh = lambda n: [f"r{rng.getrandbits(60)}" for _ in range(n)]
    passages = [fresh(80) for _ in range(20)]
    texts, holders = [], defaultdict(list)
    for turn in range(2):
        for p in passages:
            texts += [fresh(20) + p[i : i + 12] + fresh(20) for i in range(0, 69, 2) for _ in range(2)]
        for n, p in enumerate(passages):
            holders[n].append(len(texts))
            texts.append(fresh(30) + p + fresh(30))
    was = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    try:
        got = substring_dedup.shared_passages(spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], DOCS)).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", was)
    assert {(r.doc_id, r.other_id) for r in got} == {(b, a) for a, b in holders.values()}


def test_holders_of_one_passage_are_one_class_and_pieces_do_not_matter(spark, monkeypatch):
    rng = random.Random(6)
    fresh = lambda n: [f"r{rng.getrandbits(60)}" for _ in range(n)]
    passage, lone = fresh(60), fresh(60)
    rows = [(f"d{i:03}", " ".join(fresh(rng.randint(0, 20)) + passage + fresh(rng.randint(0, 20)))) for i in range(200)]
    rows += [("e1", " ".join(lone + fresh(9))), ("e2", " ".join(fresh(9) + lone)), ("e3", " ".join(fresh(9))), ("e2", " ".join(fresh(60)))]
    df = spark.createDataFrame(rows, "doc_id string, text string")
    got = substring_dedup.shared_passages(df).collect()
    texts = dict(rows)
    assert {r.class_id for r in got if r.doc_id[0] == "d" and texts[r.doc_id] != texts[r.other_id]} == {"d000"} and {r.doc_id for r in got} | {r.other_id for r in got} == {r[0] for r in rows} - {"e3"}
    assert [(r.class_id, r.class_start) for r in got if r.doc_id[0] == "e"] == [("e1", 0)] and len(got) < 2000


def test_partners_in_pieces_reach_all_classes():
    rng = np.random.default_rng(0)
    n = 500
    cols = np.zeros(n, np.int64), np.sort(rng.integers(0, 300, n)) << 3 | 7, np.arange(n) + 1, np.zeros(n, np.int32)
    (a, _, b, _, size), often = substring_dedup.partners(*cols, np.zeros(n, bool), k=5, min_words=50)
    groups = Groups()
    for x, y in zip(a, b, strict=True):
        groups.join(int(x), int(y))
    assert len({groups.find(int(i)) for i in cols[2]}) == 1 and (a > b).all() and set(size) <= {5, 12, 25, 50} and len(a) <= n * (substring_dedup.NEAR + 1)


def test_a_passage_is_found_past_stray_seeds_and_short_periods(spark):
    passage = [f"p{i}" for i in range(60)]
    stray = [" ".join([f"s{i}x{j}" for j in range(60)] + passage[i : i + 5] + [f"r{i}x{j}" for j in range(60)]) for i in range(56) for _ in range(20)]
    line = " ".join(f"l{i}" for i in range(7))
    texts = [" ".join(passage), *stray, " ".join(passage + ["end"]), " ".join(["word"] * 70), "start " + " ".join(["word"] * 60), " ".join([line] * 12), "x " + " ".join([line] * 9)]
    got = {(r.doc_id, r.other_id) for r in substring_dedup.shared_passages(spark.createDataFrame(list(enumerate(texts)), DOCS)).collect()}
    n = len(stray) + 1
    assert {(n, 0), (n + 2, n + 1), (n + 4, n + 3)} <= got


def test_a_passage_is_found_beside_a_stray_seed(spark):
    passage, phrase = [f"p{i}" for i in range(60)], [f"f{i}" for i in range(5)]
    between = lambda c: [f"{c}{i}" for i in range(24)]
    texts = [" ".join([*between("m"), *phrase, *between(c), *passage, *between(d), *phrase, *between(c + d)]) for c, d in ("ab", "gh")]
    got = substring_dedup.shared_passages(spark.createDataFrame(list(enumerate(texts)), DOCS)).collect()
    assert any(set(range(53, 113)) <= set(range(r.start, r.end)) and r.similarity >= 0.8 for r in got)


def test_windows_and_matches_against_brute_force(monkeypatch):
    rng = random.Random(5)
    for bits in (1 << 28, 30):
        monkeypatch.setattr(substring_dedup, "MAX_BITS", bits)
        for _ in range(200):
            a, b = ([rng.randint(0, 6) for _ in range(rng.randint(1, 40))] for _ in range(2))
            at = substring_dedup.matches(a, b)
            assert len(at) == substring_dedup.common(np.array(a, np.uint32), np.array(b, np.uint32)) and all(a[i] == b[j] for i, j in at)
            assert all(p[0] < q[0] and p[1] < q[1] for p, q in zip(at, at[1:]))
            size = lambda f, e: max(at[e][0] - at[f][0], at[e][1] - at[f][1]) + 1
            fits = [size(f, e) for f in range(len(at)) for e in range(f, len(at)) if size(f, e) >= 8 and e - f + 1 >= 0.6 * size(f, e)]
            got = substring_dedup.windows(np.array(at).reshape(-1, 2), 8, 0.6)
            assert max((size(f, e) for f, e in got), default=0) == max(fits, default=0)


def test_passages_with_many_edits_are_found(spark):
    rng = random.Random(11)
    fresh = lambda n: [f"r{rng.getrandbits(60)}" for _ in range(n)]
    rows, want = [], 0
    for i in range(120):
        passage = fresh(60)
        changed = list(passage)
        for j in rng.sample(range(60), (6, 9, 11)[i % 3]):
            changed[j] = fresh(1)[0]
        rows += [(2 * i, " ".join(fresh(70) + passage + fresh(70))), (2 * i + 1, " ".join(fresh(50) + changed + fresh(50)))]
        want += 1
    got = {(r.doc_id, r.other_id) for r in substring_dedup.shared_passages(spark.createDataFrame(rows, DOCS)).collect()}
    assert got <= {(2 * i + 1, 2 * i) for i in range(120)} and len(got) >= 0.97 * want


def test_chains_are_the_best_ordered_matches(monkeypatch):
    monkeypatch.setattr(substring_dedup, "LONG_GAP", 1000)
    rng = random.Random(1)
    for _ in range(200):
        segments = []
        for _ in range(rng.randint(1, 7)):
            x, y, n = rng.randint(0, 40), rng.randint(0, 40), rng.randint(3, 9)
            segments.append((x, x + n, y, y + n, n))

        def best(i):
            x0, _, y0, _, w = segments[i]
            return w + max([0] + [best(j) - substring_dedup.GAP_COST * (x0 - s[1] + y0 - s[3]) for j, s in enumerate(segments) if s[1] <= x0 and s[3] <= y0])

        assert substring_dedup.chains(segments)[0][0] == pytest.approx(max(best(i) for i in range(len(segments))))


def test_common_is_the_longest_common_subsequence():
    rng = random.Random(2)
    for _ in range(200):
        a, b = ([rng.randint(0, 4) for _ in range(rng.randint(0, 30))] for _ in range(2))
        t = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                t[i + 1][j + 1] = t[i][j] + 1 if x == y else max(t[i][j + 1], t[i + 1][j])
        assert substring_dedup.common(np.array(a, np.uint32), np.array(b, np.uint32)) == t[-1][-1]


def test_four_kmers_in_a_row_have_a_seed():
    rng = np.random.default_rng(0)
    for n in (0, 4, 5, 12, 200):
        at = substring_dedup.syncmers(rng.integers(0, 2**63, n).astype(np.uint64), 5)
        assert len(at) == 0 if n < 5 else np.diff(np.r_[-1, at, n - 4]).max() <= 4
    for period in (1, 2, 7):  # short periods have few seeds
        assert len(substring_dedup.seeds_of(" ".join(f"w{i % period}" for i in range(1000)), 5, 50)[0]) <= 20 * period + 50


def test_words_are_those_of_the_pattern():
    texts = ["Ab, c_d e.f--g  \u3000É1 ... ß\u2028x 'y' 2_3_4\x1cz", "", " . ", "a", "!a b!"]
    for t in texts:
        assert substring_dedup.word_hashes(t).tolist() == [xxhash.xxh64_intdigest(w) for w in substring_dedup.WORDS.findall(t.lower())]


def test_contexts_agree_as_far_as_the_words_do():
    rng = np.random.default_rng(1)
    words = rng.integers(0, 2**63, 90).astype(np.uint64)
    context = lambda w, p: substring_dedup.contexts(substring_dedup.Rolling(w), np.array([p]), 50)
    for same in (5, 12, 30, 50, 70):
        other = np.r_[rng.integers(0, 2**63, 9).astype(np.uint64), words[:same], rng.integers(0, 2**63, 70).astype(np.uint64)]
        assert substring_dedup.agreement(context(words, 0), context(other, 9), 5, 50)[0] == max(n for n in (5, 12, 25, 50) if n <= same)
    short = context(words[:20], 0), context(words[:20].copy(), 0)
    assert (short[0] == short[1]).all() and substring_dedup.agreement(*short, 5, 50)[0] == 12


def test_the_sieve_lets_all_passages_through():
    rng = np.random.default_rng(2)
    word = lambda n: rng.integers(0, 2**32, n, dtype=np.uint32)
    a, b = [], []
    for i in range(300):
        p = word(50)
        q = p.copy()
        q[rng.choice(50, 10, replace=False)] = word(10)
        a.append(np.r_[word(30), p, word(30)]), b.append(np.r_[word(9), q] if i % 2 else word(100))
    a.append(word(0)), b.append(word(3))
    got = substring_dedup.Sieve(50, 0.8)(a, b)
    assert got[1:300:2].all() and not got[:301:2].any()


# -- line dedup -----------------------------------------------------------------------------------------


def brute_lines(rows, min_words=2):
    key = lambda t: ctypes.c_int64(xxhash.xxh64_intdigest(t.encode(), 42)).value
    docs = sorted({(i is not None, i or 0, key(t), t) for i, t in rows if t is not None})
    split = [[(n, x.strip(line_dedup.BLANK)) for n, x in enumerate(d[3].split("\n")) if x.strip(line_dedup.BLANK)] for d in docs]
    places = defaultdict(list)
    for d, ls in enumerate(split):
        for k, (_, x) in enumerate(ls):
            places[x].append((d, k))
    seen, out = set(), {}
    for d, ls in enumerate(split):
        gone, longest = set(), 0
        for k, (n, x) in enumerate(ls):
            if x in seen and len(x.split()) >= min_words:
                gone.add(n)
            seen.add(x)
            if k + 1 < len(ls):
                pair = (x, ls[k + 1][1])
                if pair in seen:
                    gone |= {n, ls[k + 1][0]}
                seen.add(pair)
            for d2, k2 in places[x]:
                m = 0
                while (d2, k2) != (d, k) and k + m < len(ls) and k2 + m < len(split[d2]) and ls[k + m][1] == split[d2][k2 + m][1]:
                    m += 1
                longest = max(longest, m)
        rest = [x for j, x in enumerate(docs[d][3].split("\n")) if j not in gone]
        text = docs[d][3] if not gone else "\n".join(rest) if any(x.strip(line_dedup.BLANK) for x in rest) else ""
        out[docs[d][1] if docs[d][0] else None, docs[d][3]] = (len(ls), len(gone), longest, text)
    return out


@pytest.mark.parametrize("rows_a_task", [50_000, 9])
def test_later_copies_of_line_runs_go(spark, monkeypatch, rows_a_task):
    monkeypatch.setattr(line_dedup, "ROWS_A_TASK", rows_a_task)
    rng = random.Random(1)
    kinds = ["a b", "c", "d e f", "", "  g ", "h i\r", "jj kk", "x"]
    rows = [(i, "\n".join(rng.choice([*kinds, *[f"u{i} {rng.random()}"] * 3]) for _ in range(rng.randint(0, 14)))) for i in range(40)]
    rows += [(100 + i, rows[i % 5][1]) for i in range(8)] + [(200, "a b\n" * 20), (201, None), (202, ""), (None, "a b\nc"), (3, rows[3][1])]
    want = brute_lines(rows)
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], DOCS + ", h string, ln int").repartition(3)
    plain = spark.createDataFrame(rows, DOCS)
    got = line_dedup.drop_repeated_lines(df).collect()
    assert len(got) == len(rows) and {r.h for r in got} == {"x"}
    texts = defaultdict(list)
    for i, t in rows:
        texts[i].append(t)
    have = sorted((str(r.doc_id), r.n_lines, r.n_deleted, r.longest_run, str(r.text)) for r in got)
    assert have == sorted((str(i), *(want[i, t] if t is not None else (0, 0, 0, None))) if t is not None else (str(i), 0, 0, 0, "None") for i, t in rows)
    assert plain.count() == len(rows)


def test_long_runs_and_one_line_everywhere(spark, monkeypatch):
    monkeypatch.setattr(line_dedup, "ROWS_A_TASK", 20_000)
    run = [f"l{i} x" for i in range(30_000)]
    other = [*run[:17_000], "odd one", *run[17_001:]]
    rows = [(1, "\n".join(run)), (2, "\n".join(other)), (3, "same\n" * 50_000), (4, "same"), (5, "a\nb\nsame\nc")]
    got = {r.doc_id: r for r in line_dedup.drop_repeated_lines(spark.createDataFrame(rows, DOCS)).collect()}
    assert [(got[i].n_lines, got[i].n_deleted, got[i].longest_run) for i in range(1, 6)] == [(30_000, 0, 17_000), (30_000, 29_999, 17_000), (50_000, 49_999, 49_999), (1, 0, 1), (4, 0, 1)]
    assert got[2].text == "odd one" and got[3].text.strip() == "same"


def test_line_dedup_of_an_empty_table(spark):
    assert line_dedup.drop_repeated_lines(spark.createDataFrame([], DOCS)).count() == 0


# -- SimHash ----------------------------------------------------------------------------------------------


def test_fingerprint_is_the_majority_of_shingle_hashes():
    for text in ("", "One", "a B", "A b C", "x\x1cy z w　v", "É e É e É", "the the the the the"):
        words = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text).encode().split()
        shingles = [b" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
        h = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
        assert simhash.fingerprint(text.encode()) == sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


@pytest.mark.parametrize("leaves", [1, 2, 7])
def test_tree_finds_all_close_pairs(leaves):
    rng = np.random.default_rng(leaves)
    points = rng.integers(0, 2**64, 2000, dtype=np.uint64)
    near = points[rng.integers(0, 100, 1500)]
    for _ in range(3):
        near = near ^ (np.uint64(1) << rng.integers(0, 64, len(near)).astype(np.uint64))
    points = np.unique(np.r_[points, near])
    want, got = simhash.Forest(len(points)), simhash.Forest(len(points))
    want.join(*np.nonzero(simhash.hamming(points[:, None], points[None, :]) <= 3))
    tree = simhash.build_tree(points[::2], leaves, rng)
    stops, own = list(simhash.route(tree, points, 3)), np.zeros(len(points), int)
    for leaf, at, home in stops:
        own[at[home]] = leaf
    for leaf, at, home in stops:
        keep = leaf >= own[at]
        simhash.link(points, at[keep & home], at[keep & ~home], 3, got, rng)
    everyone = np.arange(len(points))
    assert (want.find(everyone) == got.find(everyone)).all()


@pytest.mark.parametrize("guests", [4, 65_536])
def test_near_duplicates(spark, monkeypatch, guests):
    """Shards of 64 classes have more than 4 visitors, which then come in several pieces."""
    monkeypatch.setattr(simhash, "SHARD", 64)
    monkeypatch.setattr(simhash, "GUESTS", guests)
    rng = random.Random(5)
    base = [[rng.choice("abcdefgh") * rng.randint(1, 5) for _ in range(rng.randint(0, 80))] for _ in range(150)]
    rows = [(i, " ".join(w)) for i, w in enumerate(base)] + [(1000 + i, " ".join(base[i % 20])) for i in range(60)]
    rows += [(2000 + i, " ".join(base[i][:-1] + ["z"])) for i in range(20)] + [(3000, None), (3001, ""), (None, ""), (1, rows[1][1])]
    df = spark.createDataFrame([(*r, 1) for r in rows], DOCS + ", fp int")
    got = simhash.near_duplicates(df).collect()
    assert len(got) == len(rows)
    prints = [simhash.fingerprint((t or "").encode()) for _, t in rows]
    groups = Groups()
    for a in set(prints):
        for b in set(prints):
            if (a ^ b).bit_count() <= 3:
                groups.join(a, b)
    least = {}
    for (i, _), p in zip(rows, prints, strict=True):
        if i is not None:
            least[groups.find(p)] = min(i, least.get(groups.find(p), i))
    want = sorted((str(i), f"{p:016x}", least[groups.find(p)]) for (i, _), p in zip(rows, prints, strict=True))
    assert sorted((str(r.doc_id), r.fingerprint, r.component_id) for r in got) == want
    assert simhash.near_duplicates(df.limit(0)).count() == 0


def test_a_tight_group_takes_little_memory():
    rng = np.random.default_rng(3)
    flips = np.array([np.uint64(1) << np.uint64(b) for b in range(64)], np.uint64)
    center = rng.integers(0, 2**64, 1, dtype=np.uint64)
    points = np.unique(np.r_[center, center ^ flips, (center ^ flips)[:, None].ravel() ^ flips[::-1], (center ^ flips[:, None] ^ flips[None, :]).ravel()])
    forest = simhash.Forest(len(points))
    tracemalloc.start()
    simhash.link(points, np.arange(len(points)), np.arange(0), 3, forest, rng)
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert len(np.unique(forest.find(np.arange(len(points))))) == 1 and most < 40e6
    guests, forest = np.arange(0, len(points), 2), simhash.Forest(len(points))
    simhash.link(points, np.arange(1, len(points), 2), guests, 3, forest, rng, False)
    want = simhash.Forest(len(points))
    x, y = np.nonzero(simhash.hamming(points[1::2][:, None], points[guests][None, :]) <= 3)
    want.join(np.arange(1, len(points), 2)[x], guests[y])
    assert (want.find(np.arange(len(points))) == forest.find(np.arange(len(points)))).all()


def test_components_of_paths_stars_and_rings(spark):
    edges = [(i, i + 1) for i in range(60)] + [(1000, 1000 + i) for i in range(1, 50)] + [(2000 + i, 2000 + (i + 1) % 30) for i in range(30)] + [(5, 5)]
    random.Random(0).shuffle(edges)
    got = connected_components(spark.createDataFrame(edges, "a long, b long"), Tables(spark, "test")).collect()
    assert all(r.root == r.node // 1000 * 1000 for r in got) and len(got) == 61 + 50 + 30


@pytest.mark.parametrize("parts", [2, 7])
@pytest.mark.parametrize(("every", "others", "size"), [(10, 100, 26), (7, 45, 11), (7, 200, 11), (0, 45, 11)])
def test_edited_passages_are_found_among_fragments(spark, parts, every, others, size):
    """20 pairs share 80 words, one in `every` of them changed; for each pair, other documents hold fragments of it, so that all its seeds are frequent."""
    rng = random.Random(every * others + size)
    vocabulary = [f"w{i}" for i in range(60_000)]
    fill = lambda n: [rng.choice(vocabulary) for _ in range(n)]
    docs, pairs = [], set()
    for _ in range(20):
        passage = fill(80)
        edited = [rng.choice(vocabulary) if every and i % every == every - 1 else w for i, w in enumerate(passage)]
        pairs.add((len(docs) + 1, len(docs)))
        docs += [fill(30) + passage + fill(30), fill(40) + edited + fill(20)]
        docs += [fill(30) + passage[at : at + size] + fill(30) for at in (rng.randrange(81 - size) for _ in range(others))]
    rows = [(i, " ".join(d)) for i, d in enumerate(docs)]
    rng.shuffle(rows)
    was = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", str(parts))
    try:
        got = {(r.doc_id, r.other_id) for r in substring_dedup.shared_passages(spark.createDataFrame(rows, DOCS)).select("doc_id", "other_id").collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", was)
    assert got == pairs


@pytest.mark.parametrize("cell", [16, 1024])
def test_all_classes_of_frequent_seeds_are_compared(spark, monkeypatch, cell):
    """As above, with an edit every six words: few pairs of frequent seeds are left, and neighbours alone find 17 of 20."""
    monkeypatch.setattr(substring_dedup, "CELL", cell)
    rng = random.Random(626)
    vocabulary = [f"w{i}" for i in range(60_000)]
    fill = lambda n: [rng.choice(vocabulary) for _ in range(n)]
    docs, pairs = [], set()
    for _ in range(20):
        passage = fill(80)
        edited = [rng.choice(vocabulary) if i % 6 == 5 else w for i, w in enumerate(passage)]
        pairs.add((len(docs) + 1, len(docs)))
        docs += [fill(30) + passage + fill(30), fill(40) + edited + fill(20)]
        docs += [fill(30) + passage[at : at + 26] + fill(30) for at in (rng.randrange(55) for _ in range(100))]
    rows = [(i, " ".join(d)) for i, d in enumerate(docs)]
    rng.shuffle(rows)
    found = lambda **kw: {(r.doc_id, r.other_id) for r in substring_dedup.shared_passages(spark.createDataFrame(rows, DOCS), **kw).select("doc_id", "other_id").collect()}
    assert found() == pairs and (cell == 16 or found(exact=False) < pairs)


def test_pairs_of_seeds_that_cannot_be_passages_are_not_shuffled(spark, monkeypatch):
    """200 texts share 14 words, 19,900 pairs for each of its seeds; two of them share an edited passage around it."""
    rng = random.Random(14)
    fresh = lambda n: [f"r{rng.getrandbits(60)}" for _ in range(n)]
    line, passage = fresh(14), fresh(80)
    edited = lambda: [w if i % 6 != 5 else fresh(1)[0] for i, w in enumerate(passage)]
    rows = [(i, " ".join([*fresh(40), *line, *fresh(40)])) for i in range(200)] + [(200 + i, " ".join([*fresh(30), *passage[:40], *line, *passage[40:], *fresh(30)] if not i else [*fresh(50), *edited()[:40], *line, *edited()[40:]])) for i in range(2)]
    counts, chained = [], substring_dedup.chained
    monkeypatch.setattr(substring_dedup, "chained", lambda links, **kw: (counts.append(links.count()), chained(links, **kw))[1])
    got = {(r.doc_id, r.other_id) for r in substring_dedup.shared_passages(spark.createDataFrame(rows, DOCS)).collect()}
    assert got == {(201, 200)} and max(counts) < 100 * len(rows)


def test_joined_matches_give_the_same_chains(spark):
    rng = random.Random(3)
    rows = sorted({(9, x, b, x + d, rng.choice((5, 12))) for b in (1, 2) for d in (-3, 0, 40) for x in (rng.randrange(3, 300) for _ in range(60))})
    cols = [np.array(c) for c in zip(*rows, strict=True)]
    less = substring_dedup.joined(*cols)
    chains = [sorted(map(tuple, substring_dedup.chained(spark.createDataFrame([tuple(map(int, r)) for r in zip(*c, strict=True)], "a long, x int, b long, y int, n int"), k=5).collect())) for c in (cols, less)]
    assert chains[0] == chains[1] and len(less[0]) < len(rows)


def test_passages_have_as_many_bigrams_in_common_as_the_bound():
    rng = np.random.default_rng(5)
    need = substring_dedup.least_bigrams(50, 0.8)
    for _ in range(50):
        words = rng.integers(0, 30, 50).astype(np.uint32)
        lost, put = (np.sort(rng.choice(49, 10, replace=False)) for _ in range(2))
        other = np.insert(np.delete(words, lost), np.minimum(put, 40), 1 << 20)
        one, two = (substring_dedup.bigrams(w, need) for w in (words, other))
        assert len(np.intersect1d(one, two)) >= need
    assert need == 19 and (substring_dedup.bigrams(np.zeros(500, np.uint32), need) > 0).sum() == need


def test_words_in_a_window_are_counted_as_often_as_the_other_has_them():
    rng = np.random.default_rng(8)
    a, b = ([rng.integers(0, n, rng.integers(1, 90)).astype(np.uint32) for n in (2, 4, 9, 30) for _ in range(25)] for _ in range(2))
    least = lambda u, v: sum(min(int((u == w).sum()), int((v == w).sum())) for w in set(u.tolist()))
    want = [max(least(u[i : i + 20], v) for i in range(len(u))) for u, v in zip(a, b, strict=True)]
    assert substring_dedup.counted(a, b, 20).tolist() == want


@pytest.mark.parametrize("similarity", [0.6, 0.8, 0.95])
def test_a_passage_has_its_least_words_in_a_window_of_both_texts(similarity):
    rng = np.random.default_rng(9)
    wide, least = substring_dedup.window_words(50, similarity), substring_dedup.least_words(50, similarity)
    a, b = [], []
    for n in [50, 51, 59, 60, 61, 75, 99, 100, 101, 119, 140, 180, 181, 300] * 4:
        matched = int(np.ceil(similarity * n - 1e-9))
        for rows in (a, b):  # the others are anywhere, also in one place
            words = np.arange(1000, 1000 + n, dtype=np.uint32)
            at = rng.integers(0, n - 1) if rng.random() < 0.5 else None
            lost = rng.choice(np.arange(1, n - 1), (n - matched) // 2, replace=False) if at is None else np.arange(max(1, at), min(n - 1, max(1, at) + (n - matched) // 2))
            words[lost] = rng.integers(1 << 20, 1 << 30, len(lost))
            rows.append(words)
    assert substring_dedup.counted_in_both(a, b, wide, least).all()


def test_the_sieve_counts_a_word_no_oftener_than_both_texts_have_it():
    run = lambda word, n: np.full(n, word, np.uint32)
    a, b = np.r_[run(1, 21), run(2, 19), run(3, 90)], np.r_[run(4, 60), run(3, 19), run(2, 70)]
    got = substring_dedup.Sieve(50, 0.8)([a, a, b], [b, np.r_[run(2, 5), run(3, 45)], b])
    assert got.tolist() == [False, True, True]


def test_bits_of_tokens_bound_what_stretches_have_in_common():
    rng = np.random.default_rng(10)
    owner = np.sort(rng.integers(0, 1500, 150_000))
    tokens = substring_dedup.Tokens(1501, *substring_dedup.numbered(owner, rng.integers(0, 400, len(owner)).astype(np.uint32), 19))
    which = np.arange(1501)
    for s in (0, 7, 1499, 1500):
        there = np.zeros(1 << 16, bool)
        there[tokens.own(s)] = True
        assert (tokens.most(s, tokens, which) >= tokens.hits(there, which)).all() and tokens.most(s, tokens, which[s : s + 1])[0] == len(tokens.own(s))


@pytest.mark.parametrize("copies", [1, 6])
def test_runs_of_one_word_make_no_chains_where_no_passage_is(spark, monkeypatch, copies):
    """150 texts have a run of the same word, 21 long, between runs of their own, 11,175 pairs of which neighbours alone are chained; two more share an edited passage with such a run."""
    rng = random.Random(15)
    fresh = lambda n: [f"r{rng.getrandbits(60)}" for _ in range(n)]
    passage = fresh(60)
    edited = lambda: [w if i % 7 != 6 else fresh(1)[0] for i, w in enumerate(passage)]
    docs = [[*fresh(1) * 30, *["same"] * 21, *fresh(1) * 30] for _ in range(150)] + [[*fresh(20), *edited()[:30], *["same"] * 21, *edited()[30:], *fresh(20)] for _ in range(2)]
    monkeypatch.setattr(substring_dedup, "COPIES", copies)
    counts, aligned = [], substring_dedup.aligned
    monkeypatch.setattr(substring_dedup, "aligned", lambda spans, texts, **kw: (counts.append(spans.count()), aligned(spans, texts, **kw))[1])
    got = {(r.doc_id, r.other_id) for r in substring_dedup.shared_passages(spark.createDataFrame([(i, " ".join(d)) for i, d in enumerate(docs)], DOCS)).collect()}
    assert got == {(151, 150)} and counts[1] < 11_175


def test_chains_in_runs_of_one_word(spark):
    """Runs that are the only words in common: too short ones hold no passage, unless a chain leads out of them (by equal hashes of contexts) and is one as a whole."""
    run = lambda word, n: np.full(n, word, np.uint32)
    texts = [(1, np.r_[run(1, 90), run(9, 56), run(2, 90)]), (2, np.r_[run(3, 90), run(9, 49), run(4, 90)]), (3, np.r_[run(5, 90), run(9, 70), run(6, 90)]), (4, np.r_[run(7, 90), run(9, 20), run(8, 1), run(9, 30)])]
    table = spark.createDataFrame([(h, bytearray(w.tobytes())) for h, w in texts], "h long, words binary")
    chains = [(2, 1, 90, 139, 90, 139), (2, 1, 90, 139, 97, 146), (2, 1, 90, 150, 90, 150), (3, 1, 100, 156, 90, 146), (4, 1, 90, 110, 90, 110)]
    got = sorted(map(tuple, substring_dedup.aligned(spark.createDataFrame(chains, "a long, b long, x0 long, x1 long, y0 long, y1 long"), table, margin=50, min_words=50, similarity=0.8).collect()))
    assert got == [(2, 1, 90, 150, 90, 150, 49 / 60), (3, 1, 100, 156, 90, 146, 1.0), (4, 1, 90, 141, 90, 140, 50 / 51)]


def test_rows_that_agree_to_the_ends_of_their_texts_are_compared(spark):
    """All end with the same 39 words, too few for a passage; only two share the twelve before them."""
    rng = random.Random(8)
    fresh = lambda n: [f"r{rng.getrandbits(60)}" for _ in range(n)]
    end, before = fresh(39), fresh(12)
    texts = [fresh(60) + end, fresh(30) + before + end, fresh(45) + before + end, *[fresh(60) + end for _ in range(40)]]
    got = {(r.doc_id, r.other_id) for r in substring_dedup.shared_passages(spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], DOCS)).collect()}
    assert got == {(2, 1)}


def test_pairs_of_frequent_seeds_do_not_depend_on_batches():
    rng = np.random.default_rng(4)
    h = np.repeat(np.arange(30), rng.integers(1, 40, 30))
    pos = np.concatenate([np.sort(rng.choice(200, n, replace=False)) for n in np.bincount(h)])
    seed = rng.integers(-(2**62), 2**62, len(h))
    whole = set(zip(*(x.tolist() for x in substring_dedup.paired(h, pos, seed)), strict=True))
    for i in range(30):
        own = np.flatnonzero(h == i)
        part = substring_dedup.paired(h[own], pos[own], seed[own])
        assert {(int(own[a]), b, c) for a, b, c in zip(*(x.tolist() for x in part), strict=True)} == {w for w in whole if h[w[0]] == i}
    for at, _, far in whole:
        low, stop = next(s for s in substring_dedup.STROBES if s[0] <= far < s[1])
        assert low <= far < stop and pos[at] + far in pos[h == h[at]]


def test_lines_of_one_very_long_word_or_many_words(spark):
    long, many = "x" * 300_000, "word " * 100_000
    rows = [(1, f"{long}\n{many}\nshort line"), (2, f"{long}\n{many}"), (3, f"{long}\nanother line"), (4, long)]
    got = {r.doc_id: (r.n_lines, r.n_deleted) for r in line_dedup.drop_repeated_lines(spark.createDataFrame(rows, DOCS)).collect()}
    assert got == {1: (3, 0), 2: (2, 2), 3: (2, 0), 4: (1, 0)}  # one word alone isn't a run of two words
