"""Sources: character references, line numbers over splits, nested takeout documents, archives."""

import html
import json
import random
import tracemalloc
import zipfile
from html.entities import html5

import pytest
from pyspark.sql import functions as F

from tessera.functions import text as T
from tessera.plans import archive
from tessera.sources import archives, conversations


def test_every_entity_is_resolved_as_html_says(spark):
    texts = [f"a&{name} b" for name in html5] + [f"x&{name.rstrip(';')}y" for name in html5] + [f"&#{n};" for n in (0, 9, 13, 38, 65, 127, *range(0x80, 0xA0), 0xD7FF, 0xD800, 0xDFFF, 0xFFFE, 0x1F600, 0x10FFFF, 0x110000, 10**9)]
    texts += [f"&#x{n:X};" for n in (0, 0x41, 0x85, 0x99, 0xD800, 0x1F4A9, 0x110000)] + ["&#65", "&#x41 b", "&#xZ;", "&#;", "&;", "&", "a && b", "AT&T", "&ampamp;", "&amp;lt;", "&notit;", "&NotEqualTilde;", "&copy2020", "&AMP;&Lt;", "&nosuch;", "", "&nbsp;&lt;&gt;&quot;&#39;&apos;&amp;"]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string").repartition(3).select("i", T.unescape(F.col("t")).alias("u"))
    got = {r.i: r.u for r in df.collect()}
    wrong = [(t, got[i], html.unescape(t)) for i, t in enumerate(texts) if got[i].replace(" ", "\xa0") != html.unescape(t).replace(" ", "\xa0")]
    assert not wrong, wrong[:5]
    assert spark.createDataFrame([(None,)], "t string").select(T.unescape(F.col("t")).alias("u")).first().u is None


def test_pages_without_rare_entities_stay_in_the_jvm(spark):
    pages = spark.createDataFrame([("<p>a&amp;b &&& c</p>",), ("<p>caf&eacute;</p>",)], "h string")
    rare = pages.where(F.col("h").rlike("&eacute")).select(T.html_to_text(F.col("h")).alias("t")).first().t
    assert rare == "café" and pages.select(T.html_to_text(F.col("h")).alias("t")).first().t == "a&b &&& c"


@pytest.mark.parametrize("size", ["64", "1000", "128m"])
def test_lines_are_numbered_over_splits(spark, tmp_path, size):
    texts = {"a.jsonl": [f"line {i} " + "x" * (i % 50) for i in range(500)], "b.jsonl": ["", "one", "", "é" * 300], "c.jsonl": [f"{i}" for i in range(50)], "d.jsonl": []}
    for name, ls in texts.items():
        (tmp_path / name).write_text("".join(x + "\n" for x in ls))
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", size)
    try:
        df = conversations.lines(spark, str(tmp_path))
        got = {(r.path.rsplit("/", 1)[1], r.number): r.line for r in df.collect()}
        plan = df._jdf.queryExecution().optimizedPlan().toString()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    assert got == {(name, i): x for name, ls in texts.items() for i, x in enumerate(ls, 1)}
    assert plan.count("Window") == 1  # over splits, not lines


def walked(spark, *documents):
    rows = conversations.takeout_records(spark.createDataFrame([(f"t/p{i}.json", d if isinstance(d, str) else json.dumps(d)) for i, d in enumerate(documents)], "path string, line string")).collect()
    return {r.external_id: (r.record_type, r.title, [(m.role, m.content) for m in r.messages]) for r in rows}


def test_lists_nested_in_any_way(spark):
    talk = lambda i: {"id": i, "messages": [{"role": "user", "content": f"hello {i}"}]}
    got = walked(spark, [[[[talk("a")], [[talk("b"), [[[[talk("c")]]]]]]]], talk("d"), [], [[]], "x", 3, None])
    assert set(got) == {"a", "b", "c", "d"} and got["c"][2] == [("user", "hello c")]
    deep = json.dumps(talk("deep"))
    assert set(walked(spark, "[" * 40 + deep + "]" * 40)) == {"deep"}


def test_kinds_of_takeout_documents(spark):
    long = "a string of more than fifty characters, as any text in here has to be"
    got = walked(
        spark,
        [{"query": {"text": "cats"}}, [{"event": "x"}, {"query": {"text": "dogs"}, "id": "q"}]],
        {"conversations": [{"conversationId": "g", "name": "N", "turns": [{"sender": "model", "parts": [{"text": "from parts"}]}]}, {"id": "empty"}, "no talk"]},
        {"note": long, "n": 5, "short": "x", "inner": {"more": long, "deeper": {"lost": long}}},
        {"messages": [], "turns": [{"text": ["one", "two"]}]},
        {"messages": "not a list"},
        "{broken",
        {"k": "x"},
    )
    assert got["t/p0.json[0]"] == ("search", "cats", [("user", "cats")]) and got["q"][1] == "dogs" and got["t/p0.json[1][0]"] == ("search", "Search", [("user", "")])
    assert got["g"] == ("conversation", "N", [("model", "from parts")]) and got["empty"] == ("conversation", "Conversation empty", [])
    assert got["t/p2.json"] == ("document", "p2", [("document", f"more: {long}\nnote: {long}")])
    assert got["t/p3.json"][2] == [("user", "one\ntwo")] and got["t/p4.json"] == ("conversation", "Conversation t/p4.jso", [])
    assert set(got) == {"t/p0.json[0]", "t/p0.json[1][0]", "q", "g", "empty", "t/p2.json", "t/p3.json", "t/p4.json"}


def zipped(path, members):
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        for name, content in members.items():
            z.writestr(name, content)


@pytest.mark.parametrize("size", [1, 2, 3, 7, 64, 10_000])
def test_blocks_of_a_stream_are_those_of_the_whole(size):
    rng = random.Random(size)
    for n in range(60):
        whole = "".join(rng.choice(["<p>", "<", "p", ">", "ab", "<p", "</p></p>", "é"]) for _ in range(rng.randrange(60))).encode()
        pieces = [whole[i : i + size] for i in range(0, len(whole), size)]
        assert list(archives.scan_blocks(pieces, b"<p>")) == [b"<p>" + x for x in whole.split(b"<p>")[1:]], (n, whole)
        ended = [b"<p>" + x.split(b"</p></p>")[0] + (b"</p></p>" if b"</p></p>" in x else b"") for x in whole.split(b"<p>")[1:]]
        assert list(archives.scan_blocks(pieces, b"<p>", b"</p></p>")) == ended


def test_blocks_hold_one_block_of_a_long_stream():
    def stream():
        for i in range(20_000):
            yield b"outer-cell" + b"x" * 3000 + b"</div></div></div>" + b"between" * 10 if i % 2 else b"no mark here " * 300

    tracemalloc.start()
    n = sum(1 for _ in archives.scan_blocks(stream(), b"outer-cell", b"</div></div></div>"))
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert n == 10_000 and most < 200_000
    assert [len(b) for b in archives.scan_blocks([b"<p>" + b"x" * 1000] * 3, b"<p>", None, 400)] == [400, 400, 400]


def test_page_blocks_equal_the_split_of_the_page(spark, tmp_path):
    pages = {f"p{i}.html": "head" + "".join(f"<p>{'words ' * (j * 37 % 900)}é{j}" for j in range(i * 3)) for i in range(6)}
    zipped(tmp_path / "takeout-1.zip", pages)
    names = archives.zip_names(archives.archive_paths(spark, str(tmp_path)))
    got = sorted((r.name, r.n, r.block) for r in archives.page_blocks(names, "<p>").collect())
    split = spark.createDataFrame(list(pages.items()), "name string, html string").select("name", F.posexplode(archives.blocks(F.col("html"), "<p>")).alias("n", "block"))
    assert got == sorted((r.name, r.n, r.block) for r in split.collect())


def test_members_by_name_and_the_fallback(spark, tmp_path):
    zipped(tmp_path / "takeout a.zip", {"x/Gemini/chat.json": "[]", "x/photo.png": "\x89", "x/other.json": "{}", "x/conversation notes.md": "n"})
    zipped(tmp_path / "takeout-b.zip", {"data.json": json.dumps([{"id": "z", "messages": [{"content": "hi"}]}]), "broken.json": "{", "readme.txt": "no"})
    zipped(tmp_path / "takeout-c.zip", {})
    (tmp_path / "takeout-d.zip").write_bytes(b"no archive")
    names = archives.text_members(archives.zip_names(archives.archive_paths(spark, str(tmp_path))))
    assert sorted((r.archive[-5], r.name, r.guess) for r in names.collect()) == [("a", "x/Gemini/chat.json", False), ("a", "x/conversation notes.md", False), ("b", "broken.json", True), ("b", "data.json", True)]
    content = archives.zip_contents(names).join(names, ["archive", "name"])
    got = archive.member_records(content).collect()
    assert sorted((r.record_type, r.title) for r in got) == [("conversation", "Conversation z"), ("document", "conversation notes.md")]


def test_activity_pages_of_archives(spark, tmp_path):
    entry = lambda i: f'<div class="outer-cell mdl">Gemini<br></p>You asked what is number {i}<br>10 abr 2026, 19:55:59 CEST<br><p>It is a long answer {i}</p></div></div></div>'
    zipped(tmp_path / "takeout-1.zip", {"Takeout/Gemini/MiActividad.html": "<html>" + "".join(map(entry, range(50))), "Takeout/other.html": entry(99), "Takeout/Modo IA/x.html": entry(77)})
    zipped(tmp_path / "my gemini.zip", {"gemini.html": entry(78)})
    zipped(tmp_path / "holiday.zip", {"gemini.html": entry(98)})
    got = archives.activity_records(spark, str(tmp_path))
    assert sorted(int(r.prompt.split()[-1]) for r in got.collect()) == [*range(50), 77, 78]
    archives.export_json_array(got.select("prompt", "response"), str(tmp_path / "out"), files=3)
    parts = [json.loads(f.read_text()) for f in (tmp_path / "out").glob("part-*")]
    assert len(parts) == 3 and sum(map(len, parts)) == 52 and {"prompt", "response"} == set(parts[0][0])
    archives.export_json_array(got.where("false").select("prompt"), str(tmp_path / "none"))
    assert [json.loads(f.read_text()) for f in (tmp_path / "none").glob("part-*")] == [[]]


def test_a_large_archive_is_listed_and_streamed_without_reading_it_whole(spark, tmp_path):
    with zipfile.ZipFile(tmp_path / "takeout-1.zip", "w", zipfile.ZIP_DEFLATED, compresslevel=1) as z, z.open("gemini.html", "w") as f:
        for i in range(300):  # 300 MB
            f.write(b"<p>" + str(i).encode() + b" " * 1_000_000)
    got = archives.page_blocks(archives.zip_names(archives.archive_paths(spark, str(tmp_path))), "<p>", None, 1000)
    assert got.count() == 300 and got.where(F.length("block") > 1000).count() == 0
