"""Checks of a tree of Markdown documents, as joins of what they refer to with what there is.

``files`` has ``path`` (relative to the root) and ``text``; hidden files and generated abstracts are
left out by :func:`documents`. Reports name what is wrong; fixes give the files as they should be.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def documents(spark: SparkSession, root: str) -> DataFrame:
    rows = spark.read.text(root, wholetext=True, recursiveFileLookup=True).select(F.col("_metadata.file_path").alias("full"), F.col("value").alias("text"))
    path = F.regexp_replace("full", "^.*?" + root.rstrip("/").replace(".", "\\.") + "/", "")
    rows = rows.select(path.alias("path"), "text")
    hidden = F.exists(F.split("path", "/"), lambda p: p.startswith("."))
    return rows.where(F.endswith("path", F.lit(".md")) & ~hidden & ~F.contains("path", F.lit(".abstract")) & ~F.contains("path", F.lit(".overview")))


def folder(path: Column) -> Column:
    return F.regexp_extract(path, "^(.*/)[^/]*$", 1)


def normal(path: Column) -> Column:
    """A relative path without . and .. segments; null if it leads out of the root."""
    start = F.struct(F.expr("cast(array() as array<string>)").alias("p"), F.lit(True).alias("ok"))

    def step(a: Column, s: Column) -> Column:
        up = s == ".."
        p = F.when((s == "") | (s == "."), a["p"]).when(up, F.slice(a["p"], 1, F.greatest(F.size(a["p"]) - 1, F.lit(0)))).otherwise(F.concat(a["p"], F.array(s)))
        return F.struct(p.alias("p"), (a["ok"] & ~(up & (F.size(a["p"]) == 0))).alias("ok"))

    return F.aggregate(F.split(path, "/"), start, step, lambda a: F.when(a["ok"], F.array_join(a["p"], "/")))


def links(files: DataFrame) -> DataFrame:
    """Relative links of every document: ``path, link, target``."""
    found = files.select("path", F.explode(F.regexp_extract_all("text", F.lit("\\]\\(([^)]+)\\)"), F.lit(1))).alias("link")).select("path", F.trim("link").alias("link"))
    found = found.where(~F.col("link").rlike("^(<|https?://|mailto:|viking://|#|data:)") & (F.col("link") != ""))
    return found.withColumn("target", F.trim(F.regexp_extract("link", "^([^#?]*)", 1))).where("target <> ''").distinct()


def broken_links(files: DataFrame) -> DataFrame:
    """``path, link, target, category, suggested``: links that lead nowhere, and where they might lead.

    A document may have moved into a folder of its name, or lie elsewhere under the same name; if there
    is just one such place it is suggested (``relative``), else a person must look (``needs_human``).
    Links into the retired folder are ``wiki_remnant``.
    """
    have = files.select(F.col("path").alias("there")).distinct()
    dirs = have.select(F.explode(F.transform(F.sequence(F.lit(1), F.size(F.split("there", "/"))), lambda i: F.array_join(F.slice(F.split(F.col("there"), "/"), 1, i), "/"))).alias("there")).distinct()
    rows = links(files).withColumn("to", normal(F.concat(folder(F.col("path")), F.col("target"))))
    old = rows.where(F.contains("target", F.lit("wiki/"))).select("path", "link", "target", F.lit("wiki_remnant").alias("category"), F.lit("").alias("suggested"))
    rows = rows.where(~F.contains("target", F.lit("wiki/"))).join(dirs, F.col("to") == F.col("there"), "left_anti")
    name = F.regexp_extract("target", "([^/]+)$", 1)
    nested = F.concat(F.regexp_replace("to", "\\.md$", ""), F.lit("/"), name)
    rows = rows.withColumn("name", name).withColumn("nested", F.when(F.endswith("target", F.lit(".md")), nested))
    rows = rows.join(have.withColumnRenamed("there", "n_there"), F.col("nested") == F.col("n_there"), "left")
    alone = have.groupBy(F.regexp_extract("there", "([^/]+)$", 1).alias("b")).agg(F.min("there").alias("only"), F.count("*").alias("c")).where("c = 1")
    rows = rows.join(alone, (F.col("name") == F.col("b")) & F.endswith("target", F.lit(".md")), "left")
    found = F.coalesce("n_there", "only")
    out = rows.select("path", "link", "target", F.when(found.isNotNull(), "relative").otherwise("needs_human").alias("category"), F.coalesce(found, F.lit("")).alias("suggested"))
    return out.unionByName(old)


def frontmatter(files: DataFrame) -> DataFrame:
    return files.select("path", F.regexp_extract("text", "(?s)\\A---\\s*\\n(.*?)\\n---", 1).alias("front")).where("front <> ''")


def trace_paths(files: DataFrame) -> DataFrame:
    """List items under ``trace`` and ``source_files`` of each document's head: ``path, ref``."""
    front = frontmatter(files)
    lists = F.concat(
        F.regexp_extract_all("front", F.lit("(?m)^(?:trace|source_files)\\s*:.*((?:\\n[ \\t].*)*)"), F.lit(1)),
        F.transform(F.regexp_extract_all("front", F.lit("(?m)^source_files\\s*:\\s*\\[(.*)\\]"), F.lit(1)), lambda s: F.concat(F.lit("\n - "), F.replace(s, F.lit(","), F.lit("\n - ")))),
    )
    refs = front.select("path", F.explode(lists).alias("l")).select("path", F.explode(F.regexp_extract_all("l", F.lit("(?m)^\\s*-\\s+(.+)$"), F.lit(1))).alias("ref"))
    return refs.select("path", F.regexp_replace(F.trim("ref"), "^[`\"']+|[`\"']+$", "").alias("ref")).where(F.col("ref").rlike("[/.]") & ~F.startswith("ref", F.lit("viking://"))).distinct()


def broken_traces(files: DataFrame, code: DataFrame) -> DataFrame:
    """Referenced code paths that don't exist, with the only file of that name if there is one.
    ``code`` has ``path``."""
    have = code.select(F.col("path").alias("there")).distinct()
    gone = trace_paths(files).withColumn("to", F.regexp_replace("ref", "^\\./", "")).join(have, F.col("to") == F.col("there"), "left_anti")
    alone = have.groupBy(F.regexp_extract("there", "([^/]+)$", 1).alias("b")).agg(F.min("there").alias("only"), F.count("*").alias("c")).where("c = 1")
    return gone.join(alone, F.regexp_extract("to", "([^/]+)$", 1) == F.col("b"), "left").select("path", "ref", F.coalesce("only", F.lit("")).alias("suggested"))


def trace_edges(files: DataFrame, node: Column) -> DataFrame:
    """Links of each document's trace: forward to code, backward to the documents it builds on."""
    front = frontmatter(files)
    part = lambda key: F.regexp_extract_all("front", F.lit(f"(?m)^[ \\t]+{key}\\s*:.*((?:\\n[ \\t]+-.*)*)"), F.lit(1))
    rows = front.select("path", F.explode(F.create_map(F.lit("forward"), F.array_join(part("forward"), "\n"), F.lit("backward"), F.array_join(part("backward"), "\n"))).alias("way", "l"))
    rows = rows.select("path", "way", F.explode(F.regexp_extract_all("l", F.lit("(?m)^\\s*-\\s+(.+)$"), F.lit(1))).alias("ref"))
    return rows.select(node.alias("source"), F.trim("ref").alias("target"), F.lit("trace").alias("relation"), "way", F.lit(1.0).alias("weight"))


def index_report(files: DataFrame) -> DataFrame:
    """Numbered folders that the index lacks (``missing``), and index rows whose link leads nowhere
    (``orphan``): ``kind, item``."""
    dirs = files.select(F.regexp_extract("path", "^((?:architecture|decisions)/\\d+-[^/]+)", 1).alias("item")).where("item <> ''").distinct()
    dirs = dirs.withColumn("number", F.regexp_extract("item", "/(\\d+)-", 1))
    rows = files.where("path = 'INDEX.md'").select(F.explode(F.regexp_extract_all("text", F.lit("(?m)^\\|.*\\]\\(([^)]+)\\).*\\|"), F.lit(1))).alias("link"))
    rows = rows.withColumn("number", F.regexp_extract("link", "(\\d+)-", 1)).withColumn("to", normal(F.regexp_extract("link", "^([^#]*)", 1)))
    missing = dirs.join(rows.select("number").distinct(), "number", "left_anti").select(F.lit("missing").alias("kind"), "item")
    have = files.select(F.col("path").alias("p")).unionByName(dirs.select(F.col("item").alias("p"))).distinct()
    orphans = rows.join(have, F.col("to") == F.col("p"), "left_anti").select(F.lit("orphan").alias("kind"), F.col("link").alias("item"))
    return missing.unionByName(orphans)


def changelog_report(files: DataFrame) -> DataFrame:
    """Rows of the changelog's table with a wrong number of cells or a wrong date, and versions without
    a section: ``line, issue``."""
    text = files.where("path = 'changelog.md'").select("text")
    lines = text.select(F.posexplode(F.split("text", "\n")).alias("i", "l"))
    row = lines.where(F.startswith("l", F.lit("|")) & ~F.col("l").rlike("^\\|\\s*-{2,}") & ~F.contains("l", F.lit("| 版本 | 日期 |")))
    row = row.withColumn("cells", F.transform(F.split(F.regexp_replace(F.trim("l"), "^\\||\\|$", ""), "\\|"), lambda c: F.trim(c)))
    wide = row.where(F.size("cells") != 5).select((F.col("i") + 1).alias("line"), F.lit("columns").alias("issue"))
    date = row.where((F.size("cells") >= 2) & ~F.element_at("cells", 2).rlike("^\\d{4}-\\d{2}-\\d{2}$")).select((F.col("i") + 1).alias("line"), F.lit("date").alias("issue"))
    told = row.select("i", F.regexp_extract(F.element_at("cells", 1), "\\*\\*(v[\\w.\\-]+)\\*\\*", 1).alias("v")).where("v <> ''")
    parts = text.select(F.explode(F.regexp_extract_all("text", F.lit("(?m)^###\\s+(v[\\w.\\-]+)"), F.lit(1))).alias("v")).distinct()
    alone = told.join(parts, "v", "left_anti").select((F.col("i") + 1).alias("line"), F.lit("section").alias("issue"))
    return wide.unionByName(date).unionByName(alone)


# -- fixes ------------------------------------------------------------------------------------------


def relative(path: Column, start: Column) -> Column:
    """``path`` as seen from the folder ``start``; both lie under the same root."""
    parts = lambda c: F.filter(F.split(c, "/"), lambda x: x != "")
    to, at = parts(path), parts(start)
    none = F.struct(F.lit(0).alias("n"), F.lit(True).alias("ok"))
    common = F.aggregate(F.zip_with(to, at, lambda a, b: F.coalesce(a == b, F.lit(False))), none, lambda s, same: F.struct((s["n"] + (s["ok"] & same).cast("int")).alias("n"), (s["ok"] & same).alias("ok")), lambda s: s["n"])
    up = F.array_repeat(F.lit(".."), F.greatest(F.size(at) - common, F.lit(0)))
    return F.array_join(F.concat(up, F.slice(to, common + 1, F.greatest(F.size(to) - common, F.lit(1)))), "/")


def patched(files: DataFrame, fixes: DataFrame) -> DataFrame:
    """Files with texts replaced: ``path, text, fixed``, the number of fixes that found their text.

    ``fixes`` has ``path, n, old, new``; those of a file are made in the order of ``n``, each everywhere in the text that
    the ones before it left. A file and its fixes are the unit of work; other files stay where they are.
    """
    own = fixes.groupBy("path").agg(F.array_sort(F.collect_list(F.struct("n", "old", "new"))).alias("_fixes"))
    start = lambda text: F.struct(text.alias("text"), F.lit(0).alias("fixed"))
    step = lambda a, x: F.struct(F.replace(a["text"], x["old"], x["new"]).alias("text"), (a["fixed"] + F.contains(a["text"], x["old"]).cast("int")).alias("fixed"))
    rows = files.join(own, "path", "left").withColumn("_done", F.when(F.col("_fixes").isNotNull(), F.aggregate("_fixes", start(F.col("text")), step)))
    return rows.select("path", F.coalesce("_done.text", "text").alias("text"), F.coalesce("_done.fixed", F.lit(0)).alias("fixed"))


def fix_links(files: DataFrame) -> DataFrame:
    """Files whose broken links lead to the only place that they can mean; others of :func:`broken_links` stay.
    ``path, text, fixed``."""
    broken = broken_links(files).where("category = 'relative' and suggested <> ''")
    new = F.concat(F.lit("]("), relative(F.col("suggested"), folder(F.col("path"))), F.lit(")"))
    fixes = broken.groupBy("path", "link").agg(F.min("suggested").alias("suggested"))
    return patched(files, fixes.select("path", F.col("link").alias("n"), F.concat(F.lit("]("), "link", F.lit(")")).alias("old"), new.alias("new")))


def fix_traces(files: DataFrame, code: DataFrame) -> DataFrame:
    """Files whose traces name code by the path of the only file of that name: ``path, text, fixed``."""
    fixes = broken_traces(files, code).where("suggested <> ''")
    return patched(files, fixes.select("path", F.col("ref").alias("n"), F.col("ref").alias("old"), F.col("suggested").alias("new")))


#: The sections of the index, with the kind of document of each, and what a row looks like.
SECTIONS = {"architecture": "arch", "decisions": "decision"}
_INDEX_ROW = r"^\|\s*\**(\d+\w*)\**\s*\|\s*\**\[([^\]]+)\]\(([^)]+)\)\**\s*\|"


def apply_index(files: DataFrame) -> DataFrame:
    """The index with rows for numbered folders that it lacks, as lines: ``line, after, text``, in the order of
    the first two.

    Lines keep their number (from 0) with ``after`` empty. New rows come after the last row of their section, or
    two lines below its heading, or at the end, and ``after`` is their number. A number that any row has isn't
    added. Lines are rows here, so an index may be of any length.
    """
    lines = files.where("path = 'INDEX.md'").select(F.posexplode(F.split("text", "\n")).alias("line", "text"))
    row = lines.withColumn("number", F.regexp_extract(F.trim("text"), _INDEX_ROW, 1)).withColumn("link", F.regexp_extract(F.trim("text"), _INDEX_ROW, 3))
    there = files.select(F.regexp_extract("path", r"^(architecture|decisions)/(\d+\w*-[^/]+)/", 1).alias("section"), F.regexp_extract("path", r"^(architecture|decisions)/(\d+\w*-[^/]+)/", 2).alias("name")).where("name <> ''").distinct()
    there = there.withColumn("number", F.regexp_extract("name", r"^(\d+\w*)-", 1))
    there = there.groupBy("number").agg(F.max_by(F.struct("section", "name"), F.struct(F.col("section") == "decisions", "name")).alias("d")).select("number", "d.*")
    missing = there.join(row.where("number <> ''").select("number").distinct(), "number", "left_anti")
    ends = [F.lit(s).alias("section") for s in SECTIONS]
    found = lambda s: F.coalesce(
        F.max(F.when((F.col("number") != "") & F.startswith("link", F.lit(s + "/")), F.col("line"))),
        F.least(F.min(F.when(F.startswith("text", F.lit("## ")) & F.contains("text", F.lit(s)), F.col("line"))) + 2, F.max("line")),
        F.max("line"),
    )
    places = row.agg(*[found(s).alias(s) for s in SECTIONS])  # one row
    places = places.select(F.explode(F.array(*[F.struct(name, F.col(s).alias("line")) for name, s in zip(ends, SECTIONS, strict=True)])).alias("p")).select("p.*").where("line is not null")
    kind = F.create_map(*[F.lit(x) for pair in SECTIONS.items() for x in pair])[F.col("section")]
    link = F.concat_ws("/", "section", "name", F.when(F.endswith("name", F.lit(".md")), F.col("name")).otherwise(F.concat("name", F.lit(".md"))))
    text = F.concat(F.lit("| "), "number", F.lit(" | ["), "name", F.lit("]("), link, F.lit(") |  | "), kind, F.lit(" |  |"))
    new = missing.join(F.broadcast(places), "section").select("line", F.col("number").alias("after"), text.alias("text"))
    return lines.select("line", F.lit("").alias("after"), "text").unionByName(new)


def code_references(code: DataFrame, files: DataFrame) -> DataFrame:
    """Documents that comments and docstrings of code name and that don't exist: ``path, ref``."""
    said = F.concat(F.regexp_extract_all("text", F.lit("(?s)\"\"\"(.*?)\"\"\""), F.lit(1)), F.regexp_extract_all("text", F.lit("(?m)#(.*)$"), F.lit(1)))
    refs = code.select("path", F.explode(said).alias("c")).select("path", F.explode(F.regexp_extract_all("c", F.lit("docs/([\\w./\\-]+[\\w\\-])"), F.lit(1))).alias("ref")).distinct()
    return refs.join(files.select(F.col("path").alias("ref")).distinct(), "ref", "left_anti").select("path", "ref")


def tree_rows(entries: DataFrame, depth: int = 6) -> DataFrame:
    """All documents under the roots of a parent-child table, at most ``depth`` levels down, each once.
    ``entries`` has ``parent, child`` (a root's parent is null)."""
    found = entries.where("parent is null").select(F.col("child").alias("node"), F.lit(0).alias("level"))
    front = found
    for level in range(1, depth + 1):
        front = front.join(entries, F.col("node") == F.col("parent")).select(F.col("child").alias("node"), F.lit(level).alias("level"))
        found = found.unionByName(front)
    order = Window.partitionBy("node").orderBy("level")
    return found.withColumn("k", F.row_number().over(order)).where("k = 1").drop("k")
