"""Fixes of documents against the standard library and by hand."""

import os
import random

from pyspark.sql import functions as F

from tracewell.operators import docs


def test_relative_paths(spark):
    draw = random.Random(3)
    some = lambda least: "/".join(draw.choice("abc") for _ in range(draw.randrange(least, 5)))
    rows = [(some(1), some(0)) for _ in range(200)]
    got = spark.createDataFrame(rows, "path string, start string").select("path", "start", docs.relative(F.col("path"), F.col("start")).alias("r")).where("path <> start and not startswith(start, path)").collect()
    assert all(r.r == os.path.relpath(r.path, r.start or ".") for r in got) and len(got) > 100


def test_links_are_fixed_where_one_place_is_meant(spark):
    files = [
        ("a/one.md", "[x](two.md) [y](../b/two.md#t) [z](gone.md) [w](wiki/two.md) [v](https://x/two.md) [u](nest.md) [x](two.md)"), ("b/c/two.md", "[back](../../a/one.md)"), ("a/nest.md/nest.md", "[m](many.md)"),
        ("p/many.md", ""), ("q/many.md", "[s](./many.md)"), ("e.md", None),
    ]
    got = {r.path: (r.text, r.fixed) for r in docs.fix_links(spark.createDataFrame(files, "path string, text string")).collect()}
    assert got["a/one.md"] == ("[x](../b/c/two.md) [y](../b/c/two.md) [z](gone.md) [w](wiki/two.md) [v](https://x/two.md) [u](nest.md) [x](../b/c/two.md)", 2)
    assert {p: got[p] for p, t in files[1:]} == {p: (t, 0) for p, t in files[1:]}


def test_traces_are_fixed(spark):
    head = "---\ntrace:\n  forward:\n    - old/run.py\n    - `lost.py`\n---\nold/run.py"
    files = spark.createDataFrame([("d.md", head), ("n.md", "no head")], "path string, text string")
    code = spark.createDataFrame([("src/run.py",), ("x/two.py",), ("y/two.py",)], "path string")
    got = {r.path: (r.text, r.fixed) for r in docs.fix_traces(files, code).collect()}
    assert got == {"d.md": (head.replace("old/run.py", "src/run.py"), 1), "n.md": ("no head", 0)}


def index(spark, text, *dirs):
    files = [("INDEX.md", text)] + [(f"{d}/{d.split('/')[1]}.md", "") for d in dirs]
    rows = docs.apply_index(spark.createDataFrame(files, "path string, text string")).orderBy("line", "after").collect()
    return "\n".join(r.text for r in rows)


def test_the_index_gets_what_it_lacks(spark):
    text = "# I\n## architecture\n\n| a | b |\n| 01 | [01-a](architecture/01-a/01-a.md) | v | arch | d |\n## decisions\nx\ny\nz"
    got = index(spark, text, "architecture/01-a", "architecture/02-b", "decisions/03-c.md", "decisions/01-again", "decisions/x-no")
    lines = text.split("\n")
    assert got.split("\n") == lines[:5] + ["| 02 | [02-b](architecture/02-b/02-b.md) |  | arch |  |"] + lines[5:8] + ["| 03 | [03-c.md](decisions/03-c.md/03-c.md) |  | decision |  |"] + lines[8:]
    assert index(spark, "# I", "decisions/07-q") == "# I\n| 07 | [07-q](decisions/07-q/07-q.md) |  | decision |  |"
    assert index(spark, "| **7** | **[b](decisions/7-b/7-b.md)** | v | d | e |", "decisions/7-b") == "| **7** | **[b](decisions/7-b/7-b.md)** | v | d | e |"
