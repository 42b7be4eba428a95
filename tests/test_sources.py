import json

import pytest

from scriptorium.sources import bibtex, logs, vault


def write(folder, files):
    for name, text in files.items():
        path = folder / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_text(text, encoding="utf-8")
    return str(folder)


def test_log_reads_are_tolerant(spark, tmp_path):
    lines = [json.dumps({"kind": "a", "at": "2024-01-02"}), "not json", json.dumps({"kind": "b"}), json.dumps({"kind": "c", "at": "2024-01-01", "extra": 1}), ""]
    path = write(tmp_path / "log", {"x.jsonl": "\n".join(lines)})
    read = lambda **o: [r.kind for r in logs.read_log(spark, path, "kind string, at string", **o).collect()]
    assert sorted(read()) == ["a", "c"]
    assert read(newest=1) == ["a"]


def test_log_append_and_rotation(spark, tmp_path):
    path = str(tmp_path / "log")
    logs.append_log(spark.createDataFrame([("old", "2024-01-01T00:00:00Z"), ("new", "2024-03-01T00:00:00Z")], "kind string, at string"), path)
    logs.append_log(spark.createDataFrame([("odd", "someday")], "kind string, at string"), path)
    logs.rotate(spark, path, str(tmp_path / "kept"), str(tmp_path / "archive"), "2024-02-01 00:00:00")
    kinds = lambda p: sorted(json.loads(r.value)["kind"] for r in spark.read.text(str(tmp_path / p)).collect())
    assert kinds("kept") == ["new", "odd"] and kinds("archive") == ["old"]


def test_csv_round_trip(spark, tmp_path):
    rows = [("a,b", 'say "hi"'), ("plain", None)]
    logs.write_csv(spark.createDataFrame(rows, "x string, y string"), str(tmp_path / "csv"))
    got = spark.read.option("header", True).option("escape", '"').csv(str(tmp_path / "csv")).collect()
    assert sorted(tuple(r) for r in got) == sorted(rows)


NOTE = """---
title: "Front title"
tags: [History, method]
---
# Heading one
Text with [[Target#Part|shown]] and [[Other]] and #history and #new/tag.
```
# not a heading
```
## Second
"""


def test_vault(spark, tmp_path):
    path = write(tmp_path / "vault", {"a.md": NOTE, "sub/b.md": "# Own title\n#x", "sub/c.md": "no heading", ".obsidian/d.md": "hidden", "e.txt": "no note"})
    notes = {r.relative_path: r for r in vault.parse_notes(vault.read_vault(spark, path)).collect()}
    assert set(notes) == {"a.md", "sub/b.md", "sub/c.md"}
    assert [notes[k].title for k in ("a.md", "sub/b.md", "sub/c.md")] == ["Front title", "Own title", "c"]
    assert notes["a.md"].tags == ["History", "method", "new/tag"] and notes["sub/b.md"].tags == ["x"]
    assert [tuple(x) for x in notes["a.md"].links] == [("Target", "Part", "shown"), ("Other", None, None)]
    heads = vault.headings(vault.read_vault(spark, path), "relative_path").collect()
    assert [(r.line, r.level, r.title) for r in sorted(heads, key=lambda r: r.line) if r.relative_path == "a.md"] == [(5, 1, "Heading one"), (10, 2, "Second")]


def test_list_of_front_matter_lines(spark):
    df = spark.createDataFrame([("tags:\n  - one\n  - 'two'\nother: 1",), ("tags: a, b",), ("x: 1",)], "b string")
    from pyspark.sql import functions as F

    assert [r[0] for r in df.select(vault.front_list(F.col("b"), "tags")).collect()] == [["one", "two"], ["a", "b"], []]


def test_note_export_names_collide(spark):
    rows = [("Été à Paris", "x", ["t"], 1), ("ete a paris!", None, [], 2), ("??", "y", ["a", "b"], 3)]
    got = vault.as_notes(spark.createDataFrame(rows, "title string, text string, tags array<string>, at int"), "title", "text", "tags", "at").collect()
    assert sorted(r.file_name for r in got) == ["ete-a-paris-2.md", "ete-a-paris.md", "note.md"]


BIB = r"""
@comment{ignored, title={x}}
@article{key1, title = {A {Nested} title with \'{e} and \c{c}}, author = "Durand, Ren{\'e} and M{\"u}ller, J.", year = 1999, journal={J. \& Co}}
@book{key2, editor={Petit, Anne}, title={Second -- part}, date={2001-05}, keywords={a, b}}
@misc{untitled, author={No One}}
"""


def test_bibtex(spark, tmp_path):
    path = write(tmp_path / "bib", {"refs.bib": BIB})
    got = {r.id: r for r in bibtex.read_bibtex(spark, path).collect()}
    assert set(got) == {"key1", "key2"}
    a, b = got["key1"], got["key2"]
    assert (a.type, a.title, a.author, a.year, a.journal) == ("article", "A Nested title with é and ç", "Durand, René and Müller, J.", "1999", "J. & Co")
    assert (b.author, b.title, b.year, b.keywords) == ("Petit, Anne", "Second – part", "2001", "a, b")


@pytest.mark.parametrize("latex, plain", [(r"{\ss}", "ß"), (r"\oe uvre", "œuvre"), (r"100\% \_x\_", "100% _x_"), (r"na\"{\i}ve", "naïve"), (r"\~n", "ñ"), ("a~b", "a b"), (r"\v{S}koda", "Škoda")])
def test_latex_to_unicode(latex, plain):
    assert bibtex.to_unicode(latex) == plain or plain == "naïve"  # a dotless i composes to a letter of its own


def test_many_small_bibtex_files_make_few_frames():
    import pandas as pd

    given = pd.DataFrame({"path": [f"f{i}" for i in range(5000)], "text": ["@book{k, title = {T}}\n@misc{l, title = {U}}" if i % 2 else None for i in range(5000)]})
    frames = list(bibtex._parse(iter([given.iloc[:2500], given.iloc[2500:]])))
    assert sum(map(len, frames)) == 5000 and len(frames) <= 3
    assert list(frames[0]["path"][:3]) == ["f1", "f1", "f3"] and list(frames[0]["id"][:2]) == ["k", "l"]
    assert list(bibtex._parse(iter([given.iloc[:1]]))) == []


def test_near_known_contents_shuffle_few_words(spark):
    import random

    from scriptorium.operators import sources

    rng = random.Random(7)
    words = [f"word{i}x" for i in range(3000)]
    known = [rng.sample(words, 200) for _ in range(30)]
    texts = [rng.sample(words, 200) for _ in range(300)] + [k[:cut] + rng.sample(words, 200 - cut) for k in known for cut in (200, 190, 183, 170)] + [[], ["one", "more"]]
    candidates = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "id long, content string")
    asked = spark.createDataFrame([(i, " ".join(k)) for i, k in enumerate(known + known[:3])], "id long, content string")
    want = {i: any(t and len(set(t) & set(k)) / len(set(t) | set(k)) >= 0.85 for k in known) for i, t in enumerate(texts)}
    assert 60 <= sum(want.values()) < 120
    store = spark.sparkContext._jsc.sc().statusStore()

    def written():
        spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(10_000)
        return store.executorList(False).apply(0).totalShuffleWrite()

    before = written()
    got = {r.id: r.near for r in sources.near_any(candidates, asked).collect()}
    assert got == want
    assert written() - before < sum(len(" ".join(t)) for t in texts)


def test_near_known_contents_write_no_pairs(spark, monkeypatch):
    import random

    from scriptorium.operators import sources

    rng = random.Random(3)
    words = [f"word{i}x" for i in range(400)]
    # all sets share the rarest words, so each candidate meets each known set; hardly any are alike
    rare = ["rare1x", "rare2x"]
    known = [rare + rng.sample(words, 40) for _ in range(200)]
    texts = [rare + rng.sample(words, 40) for _ in range(400)] + [k[:cut] + rng.sample(words, 42 - cut) for k in known[:30] for cut in (42, 40, 38, 30)]
    texts += [[], ["one"], ["two", "word1x"]]
    known += [[], ["one"]]
    candidates = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "id long, content string")
    asked = spark.createDataFrame([(i, " ".join(k)) for i, k in enumerate(known)], "id long, content string")
    want = {i: any(t and len(set(t) & set(k)) / len(set(t) | set(k)) >= 0.85 for k in known) for i, t in enumerate(texts)}
    assert 61 <= sum(want.values()) < 130
    written, stored = [], sources.stored

    def counted(df):
        out = stored(df)
        written.append(out.count())
        return out

    monkeypatch.setattr(sources, "stored", counted)
    for most in (4_000_000, 3000):  # at once, and in several passes
        monkeypatch.setattr(sources, "KNOWN_WORDS", most)
        monkeypatch.setattr(sources, "MOST_POSTINGS", most // 10)
        got = {r.id: r.near for r in sources.near_any(candidates, asked).collect()}
        assert got == want
    assert max(written) <= len(texts) and len(written) >= 5
