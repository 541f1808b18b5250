"""Quality, toxicity, token counts: held-out accuracy and exact counts."""

import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.llm import compression_quality, token_counts, toxicity

P = pytest.importorskip("public_tokenizers")


def corpus(n=400, seed=0):
    rng = random.Random(seed)
    vocabulary = ["".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(2, 8))) for _ in range(400)]
    rows = []
    for i in range(n):
        words = [rng.choice(vocabulary) for _ in range(rng.randint(20, 120))]
        bad, toxic = i % 4 == 0, i % 3 == 0
        if bad:
            words = [w.upper() + "!!" for w in words] if i % 8 else [words[0]] * len(words)
        if toxic:
            words[rng.randrange(len(words))] = rng.choice(["idiot", "1d1ot", "id.i.ot", "idiooot", "i d i o t"]) if i % 2 else "grumblefool"
        rows.append((i, " ".join(words), int(not bad), int(toxic)))
    return rows


@pytest.fixture(scope="module")
def tables(spark):
    rows = corpus()
    docs = spark.createDataFrame([(i, t, "s") for i, t, _, _ in rows] + [(1000, None, "s"), (1001, "", "s"), (None, "no id", "s"), (7, rows[7][1], "s")], "doc_id long, text string, score string")
    labels = spark.createDataFrame([(i, q, t) for i, _, q, t in rows] + [(9999, 1, 1), (None, 0, 0), (1000, None, None), (5, None, None)], "doc_id long, quality int, toxic int")
    return docs, labels, {i: (q, t) for i, _, q, t in rows}


def accuracy(got, truth, which):
    held = [(r.predicted, truth[r.doc_id][which]) for r in got if r.held_out and r.doc_id in truth]
    return sum(a == b for a, b in held) / len(held)


def test_quality_on_held_out_rows(tables):
    docs, labels, truth = tables
    got = compression_quality.quality_report(docs, labels).collect()
    assert len(got) == docs.count() and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in got)
    assert accuracy(got, truth, 0) > 0.95
    again = compression_quality.quality_report(docs, labels).collect()
    assert sorted((str(r.doc_id), r.score) for r in got) == sorted((str(r.doc_id), r.score) for r in again)


def test_toxicity_on_held_out_rows(tables):
    docs, labels, truth = tables
    got = toxicity.toxicity_report(docs, labels).collect()
    assert len(got) == docs.count() and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in got)
    assert accuracy(got, truth, 1) > 0.95


@pytest.mark.parametrize("report", [compression_quality.quality_report, toxicity.toxicity_report])
def test_without_labels_or_documents(tables, report):
    docs, labels, _ = tables
    assert {r.score for r in report(docs, labels.limit(0)).collect()} <= {0.0, 0.5}
    assert report(docs.limit(0), labels).count() == 0
    assert len({r.score for r in report(docs, labels.where("quality = 1 and toxic = 1")).collect()}) == 1


def labelled(spark, which):
    d = "/root/testdata/sf0.1"
    labels = spark.read.parquet(f"{d}/labels.parquet")
    return spark.read.parquet(f"{d}/documents.parquet"), labels, {r[0]: r[1] for r in labels.select("doc_id", which).collect() if r[1] is not None}


def test_quality_fits_settle_on_any_sample(spark):
    docs, labels, truth = labelled(spark, "quality")
    rows = docs.join(labels.where("quality is not null"), "doc_id").select("doc_id", "text", "quality").collect()
    train = [(r.text or "", r.quality) for r in rows if zlib.crc32(str(r.doc_id).encode()) % 3 != 1]
    test = [((r.text or "").encode(), r.quality) for r in rows if zlib.crc32(str(r.doc_id).encode()) % 3 == 1]
    shares = {y: sum(q == y for _, q in train) for y in (0, 1)}
    for seed in range(20):
        rng = random.Random(seed)
        kinds = [[(t, y) for t, y in train if y == k] for k in (0, 1)]
        sample = [r for rows in kinds for r in rng.sample(rows, rng.choice([len(rows), len(rows) * 3 // 4]))]
        m = compression_quality.Model(sample, shares)
        p = m.scores([t for t, _ in test]) >= 0.5
        assert sum(sum(a == y for a, (_, y) in zip(p, test) if y == k) / sum(y == k for _, y in test) for k in (0, 1)) / 2 > 0.95


def test_an_ill_conditioned_calibration_settles():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(300, 1))
    a = np.c_[x, x + 1e-9 * rng.normal(size=(300, 1)), 1e4 * x**3, np.ones(300)]
    y = (x[:, 0] > 0).astype(float)  # separable
    w = compression_quality.Model.fit(a, y, np.ones(300))
    assert np.isfinite(w).all() and ((a @ w > 0) == (y > 0)).mean() > 0.97


def test_samples_are_bounded_in_bytes(tables):
    docs, labels, _ = tables
    keep = lambda c: c.isNotNull()
    all_rows, shares = compression_quality.labelled_sample(docs, labels, "quality", keep, 1000, 1 << 30, "doc_id", "text")
    some, same = compression_quality.labelled_sample(docs, labels, "quality", keep, 1000, 20_000, "doc_id", "text")
    assert shares == same and 0 < sum(len(t.encode()) for t, _ in some) <= 20_000 < sum(len(t.encode()) for t, _ in all_rows)


def test_toxicity_holds_on_rows_not_learnt_from(spark):
    docs, labels, truth = labelled(spark, "toxic")
    got = [(r.predicted, truth[r.doc_id]) for r in toxicity.toxicity_report(docs, labels).collect() if r.held_out and r.doc_id in truth]
    hits = sum(p and y for p, y in got)
    assert hits >= 0.9 * sum(p for p, _ in got) and hits >= 0.9 * sum(y for _, y in got)


def test_decoding_restores_disguises():
    words = ["idiot", "stupid", "clown", "trash", "the", "and", "of", "loser", "pathetic"]
    counts = {}
    for w in words:
        for t in toxicity.word_trigrams(w):
            counts[t] = counts.get(t, 0) + 100
    r = toxicity.Restorer(toxicity.CharacterModel(counts))
    for shown, meant in (("1d10t", "idiot"), ("$tupid", "stupid"), ("cl0wn!", "clown"), ("tr4sh", "trash"), ("l.o.s.e.r", "loser"), ("stuuupid", "stupid"), ("p@thetic,", "pathetic"), ("the", "the"), ("of,", "of")):
        assert meant in r.words(shown)
    assert list(r.spaced("you c l o w n there")) == ["clown"]


def test_spaced_words_are_told_apart():
    counts = {}
    for w in ["idiot", "stupid", "clown", "ass", "are", "a", "the", "and", "of", "loser"]:
        for t in toxicity.word_trigrams(w):
            counts[t] = counts.get(t, 0) + 100
    r = toxicity.Restorer(toxicity.CharacterModel(counts))
    for shown, meant in (("are a s t u p i d the", "stupid"), ("c l o w n i d i o t", "clown"), ("c l o w n i d i o t", "idiot"), ("the i d i o t! and", "idiot"), ("s t u p i d.", "stupid"), ("the a s s of", "ass")):
        assert meant in list(r.spaced(shown)), shown


def test_token_counts_are_the_librarys(spark):
    sentencepiece = pytest.importorskip("sentencepiece")
    path = P.path("piece_bpe_32k.model")
    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    rng = random.Random(0)
    letters = [*"abcdefghij  tions  the\n\tABC.,!é中🙂\x00▁1234", "ing", "tion", " ", "  ", "     "]
    texts = ["", " ", "▁", "<s> </s> <unk> <0x0A>", "a" * 5000, "ab" * 3000, " " * 300, "Hello  world\n\tx \x00 y🙂 "] + ["".join(rng.choice(letters) for _ in range(rng.randint(0, 60))) for _ in range(600)]
    t = token_counts.Transducer(token_counts.load_vocabulary(path))
    for x in texts:
        want = len(sp.encode(x))
        assert t.count(x) == want and t.count(x, 3) == want and t.count(x, 50) == want
    rows = [(i, x, "s") for i, x in enumerate(texts)] + [(None, None, "s"), (0, texts[0], "s")]
    got = token_counts.count_tokens(spark.createDataFrame(rows, "doc_id long, text string, n_tokens string"), path, limit=20).collect()
    want = sorted((str(i), len((x or "").encode()), len(sp.encode(x or "")), len(sp.encode(x or "")) > 20) for i, x, _ in rows)
    assert sorted((str(r.doc_id), r.n_bytes, r.n_tokens, r.over_limit) for r in got) == want
    assert token_counts.count_tokens(spark.createDataFrame([], "doc_id long, text string"), path).count() == 0


def test_token_states_are_forgotten_at_the_bound(monkeypatch):
    monkeypatch.setattr(token_counts, "MAX_STATES", 50)
    monkeypatch.setattr(token_counts, "MAX_WORDS", 20)
    t = token_counts.Transducer(token_counts.load_vocabulary(P.path("piece_bpe_32k.model")))
    text = " ".join(f"word{i} thing{i}" for i in range(300))
    import sentencepiece

    assert t.count(text) == len(sentencepiece.SentencePieceProcessor(model_file=P.path("piece_bpe_32k.model")).encode(text))


def test_held_out_follows_the_checksum(spark):
    import zlib

    from tessera.llm.common import held_out

    got = spark.range(50).select("id", held_out(F.col("id"), 3, 1).alias("h")).collect()
    assert all(r.h == (zlib.crc32(str(r.id).encode()) % 3 == 1) for r in got)
