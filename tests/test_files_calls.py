"""Files by name, pages of files as a source, and model calls: what is left after failures."""

import json
import os
import pathlib
import sys

import pytest
from pyspark import cloudpickle
from pyspark.sql import functions as F

from lutrin.operators import calls, providers
from lutrin.sources import files, io

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # workers don't have the tests


def test_a_failed_task_leaves_no_file(spark, tmp_path):
    path = str(tmp_path / "out")
    rows = spark.createDataFrame([(f"{i}.txt", f"é {i}") for i in range(40)], "name string, content string").repartition(4)
    files.write_named(rows, path)
    held = lambda: {x.name: x.read_text() for x in (tmp_path / "out").iterdir() if x.is_file()}
    whole = {f"{i}.txt": f"é {i}" for i in range(40)}
    assert held() == whole
    for bad in ("a/b", "..", "", None):
        worse = rows.withColumn("content", F.lit("new")).union(spark.createDataFrame([(bad, "x")], rows.schema))
        with pytest.raises(Exception, match="not a file's name"):
            files.write_named(worse, path)
        assert held() == whole
    with pytest.raises(Exception, match="several rows have one name"):
        files.write_named(rows.union(rows.limit(1)), path)
    assert held() == whole
    files.write_named(spark.createDataFrame([("z", None)], rows.schema), path)
    assert held() == {"z": ""}
    files.write_named(rows.limit(0), path)
    assert held() == {}


class Lines:
    """A format of pages that are lines, each of blocks that blanks separate."""

    def __init__(self, seen):
        self.seen = str(seen)

    def count(self, content):
        if content.startswith(b"broken"):
            raise ValueError("no pages")
        return len(content.splitlines())

    def rows(self, content, page):
        with open(self.seen, "a") as out:
            out.write(f"{page}\n")
        return [(i, x.decode()) for i, x in enumerate(content.splitlines()[page].split())]


def test_pages_as_a_source(spark, tmp_path):
    folder, seen = tmp_path / "in", tmp_path / "seen"
    folder.mkdir()
    (folder / "a.PDF").write_text("cover\nx y\nz\n")
    (folder / "b.pdf").write_text("\n".join(f"p{i}" for i in range(2000)))
    (folder / "c.pdf").write_text("broken")
    (folder / "d.txt").write_text("no")
    source = files.page_source("lines_of_pages", "block_no int, text string", Lines(seen))
    files.register(spark, source)
    load = lambda: spark.read.format("lines_of_pages").load(str(folder))
    rows = load().collect()
    assert {tuple(r) for r in rows if r.source == "a.PDF"} == {("a.PDF", 0, 0, "cover", None), ("a.PDF", 1, 0, "x", None), ("a.PDF", 1, 1, "y", None), ("a.PDF", 2, 0, "z", None)}
    assert sum(r.source == "b.pdf" for r in rows) == 2000
    assert [tuple(r) for r in io.errors(load()).collect()] == [("c.pdf", "ValueError: no pages")]
    seen.unlink()
    some = load().where("page_no > 0 and page_no < 3")
    assert sorted(r.text for r in some.collect()) == ["p1", "p2", "x", "y", "z"]
    assert sorted(map(int, seen.read_text().split())) == [1, 1, 2, 2]  # no other page was made
    assert sorted(r.text for r in load().where("page_no in (1, 1999)").collect()) == ["p1", "p1999", "x", "y"]
    assert load().where("page_no = 5").count() == 1
    # Large files are split by pages.
    reader = files.PagesReader(str(folder), ".pdf", 1, Lines(seen), 2)
    reader.TASK_BYTES = 4000
    parts = reader.partitions()
    assert len(parts) > 3 and sorted((a, b) for p in parts for n, a, b in p.files if n.endswith("b.pdf"))[0][0] == 0
    assert sum(r[0] == "b.pdf" for p in parts for r in reader.read(p)) == 1999
    assert files.page_source("none", "t string", Lines(seen))({"path": str(tmp_path / "out2")}) is not None


class Model:
    """Notes each prompt that it is asked; fails on some, and ends the task once at others."""

    def __init__(self, folder):
        self.folder = str(folder)

    def __call__(self):
        return self.answer

    def answer(self, prompts):
        for p in prompts:
            with open(f"{self.folder}/asked", "a") as out:
                out.write(f"{p}\n")
            if "fatal" in p and not os.path.exists(f"{self.folder}/ended"):
                pathlib.Path(f"{self.folder}/ended").touch()
                raise SystemExit
            if "bad" in p:
                raise ValueError("bad")
        return [p.upper() for p in prompts]


def test_one_failure_costs_one_answer(spark):
    class Broken:
        def __call__(self, prompts):
            if "x" in prompts:
                raise ValueError
            return ["ok"] * len(prompts)

    rows = spark.createDataFrame([(i, p) for i, p in enumerate(["a", "b", "x", "c", None])], "i int, p string").coalesce(1)
    got = rows.select("i", providers.generate(F.col("p"), Broken).alias("y")).orderBy("i").collect()
    assert [r.y for r in got] == ["ok", "ok", "", "ok", None]


def test_each_prompt_is_asked_once(spark, tmp_path):
    folder, path = tmp_path / "model", str(tmp_path / "answers")
    folder.mkdir()
    asked = lambda: (folder / "asked").read_text().split("\n")[:-1] if (folder / "asked").exists() else []
    prompts = [f"p{i}" for i in range(50)] + ["p1", "p2", None, "fatal"]
    rows = spark.createDataFrame([(i, p) for i, p in enumerate(prompts)], "i int, prompt string").repartition(4)
    with pytest.raises(Exception):  # noqa: B017
        calls.ask(rows, path, "m", Model(folder), batch=1).collect()
    first = asked()
    assert "fatal" in first
    got = {r.i: (r.answer, r.error) for r in calls.ask(rows, path, "m", Model(folder), batch=1).collect()}
    assert got == {i: (p.upper() if p else None, None) for i, p in enumerate(prompts)}
    times = {p: asked().count(p) for p in set(prompts) - {None}}
    assert times.pop("fatal") == 2 and set(times.values()) == {1}  # what was answered before the end wasn't asked again
    assert not (tmp_path / "answers" / "_calls").exists()
    # Another model has other answers; a failure is tried as often as said, and left alone then.
    more = spark.createDataFrame([(0, "p1"), (1, "bad"), (2, "new")], "i int, prompt string").coalesce(1)
    got = {r.i: (r.answer, r.error) for r in calls.ask(more, path, "m", Model(folder), batch=3, tries=2).collect()}
    assert got == {0: ("P1", None), 1: (None, "ValueError: bad"), 2: ("NEW", None)}
    count = len(asked())
    assert {r.answer for r in calls.ask(more, path, "m", Model(folder), tries=2).collect()} == {"P1", None, "NEW"} and len(asked()) == count
    assert calls.ask(more, path, "n", Model(folder)).where("i = 0").first().answer == "P1" and len(asked()) > count
    assert calls.ask(more.limit(0), str(tmp_path / "none"), "m", Model(folder)).count() == 0
    assert json.dumps(got)


def test_each_text_is_embedded_once(spark, tmp_path):
    folder = str(tmp_path)

    def make():
        def embed(texts):
            with open(f"{folder}/{os.getpid()}", "a") as out:
                out.writelines(f"{t}|\n" for t in texts)
            return [[float(len(t)), 1.0] for t in texts]

        return embed

    texts = ["a", "bb", None, "a", "", "ccc", "a"] * 9 + [f"t{i}" for i in range(30)]
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, document string").repartition(3)
    got = {r.i: r.embedding for r in providers.embed_each(rows, make, batch=4).collect()}
    assert got == {i: [float(len(t or "")), 1.0] for i, t in enumerate(texts)} == {r.i: r.embedding for r in providers.embed(rows, make).collect()}
    for x in tmp_path.iterdir():
        x.unlink()
    assert providers.embed_each(rows, make, batch=4).agg(F.sum(F.col("embedding")[1])).first()[0] == len(texts)
    asked = [y for x in tmp_path.iterdir() for y in x.read_text().split("\n")[:-1]]
    assert len(set(asked)) == 34 and max(map(asked.count, set(asked))) == 1
