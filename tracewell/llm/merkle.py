"""A Merkle manifest of a table: leaves, subroots, a root, and each row's proof.

The leaves of a group are cut into aligned buckets of 2**k. Executors run the levels inside of a bucket
as DuckDB queries over its Arrow rows (ordered ``string_agg``, then ``sha256``); Spark numbers the
leaves, takes the buckets' roots as the next tier's leaves until each group has one, does the same
over the groups, and joins the tiers' proofs.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tracewell.llm.common import BROADCAST_ROWS, fresh, leaves_nothing, materialise, small

#: Levels inside of a bucket; it holds at most 2**DEPTH leaves.
DEPTH = 12
#: The key under which the groups' subroots form a tree of their own.
TOP = "top"


def encoded(col: Column) -> Column:
    """A value as ``-`` if null, else its byte count in UTF-8, a colon and its text."""
    text = col.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def digest_of(*cols: Column) -> Column:
    return F.sha2(F.concat(*map(encoded, cols)), 256)


_LEVELS = """
SELECT spot // 2 AS spot, sha256(string_agg(h, '' ORDER BY spot)) AS h FROM nodes GROUP BY spot // 2
"""
_STEP = """
SELECT l.idx, l.spot // 2 AS spot, list_append(l.path, CASE WHEN s.h IS NULL THEN '' WHEN l.spot % 2 = 1 THEN 'L' || s.h ELSE 'R' || s.h END) AS path
FROM leaves l LEFT JOIN nodes s ON s.spot = xor(l.spot, 1)
"""
BUCKET = "key string, bucket long, idx long, path array<string>, top string"


def _bucket(table: pa.Table) -> pa.Table:
    """For each leaf of a bucket its siblings from the bottom up, and the bucket's root."""
    import duckdb

    con = duckdb.connect(config={"threads": 1})
    con.register("bucket", table)
    con.execute("CREATE TABLE nodes AS SELECT idx - min(idx) OVER () AS spot, h FROM bucket")
    con.execute("CREATE TABLE leaves AS SELECT idx, idx - min(idx) OVER () AS spot, []::VARCHAR[] AS path FROM bucket")
    for _ in range(table["levels"][0].as_py()):
        con.execute(f"CREATE TABLE next_leaves AS {_STEP}")
        con.execute(f"CREATE TABLE next_nodes AS {_LEVELS}")
        for name in ("leaves", "nodes"):
            con.execute(f"DROP TABLE {name}")
            con.execute(f"ALTER TABLE next_{name} RENAME TO {name}")
    out = con.sql("SELECT key, bucket, b.idx, l.path, (SELECT h FROM nodes) AS top FROM bucket b JOIN leaves l ON b.idx = l.idx ORDER BY b.idx").to_arrow_table()
    con.close()
    shape = pa.schema([("key", pa.string()), ("bucket", pa.int64()), ("idx", pa.int64()), ("path", pa.list_(pa.string())), ("top", pa.string())])
    return out.cast(shape)


def tier(nodes: DataFrame, counts: DataFrame, depth: int) -> DataFrame:
    """Levels of aligned buckets over ``nodes`` (``key, idx, h``): rows as ``BUCKET`` says. ``counts`` has the
    nodes of each key; a key with more than a bucket goes up ``depth`` levels in each of them."""
    width = 1 << depth
    levels = F.when(F.col("n") > width, F.lit(depth)).otherwise(F.when(F.col("n") == 1, 0).otherwise(F.length(F.bin(F.col("n") - 1)))).cast("int")
    rows = nodes.join(counts.select("key", levels.alias("levels")), "key").withColumn("bucket", F.floor(F.col("idx") / width))
    return rows.groupBy("key", "bucket").applyInArrow(_bucket, BUCKET)


def numbered(leaves: DataFrame, by: list[str]) -> DataFrame:
    """``leaves`` with ``idx``, their place from 0 within ``key`` in the order of ``by``.

    Rows are range-sorted, so a key's rows may lie in many tasks; each adds the rows of its key that
    lie in tasks before it.
    """
    rows = materialise(leaves.repartitionByRange("key", *by).withColumn("part", F.spark_partition_id()), "manifest-sorted")
    parts = materialise(rows.groupBy("key", "part").agg(F.count("*").alias("n")), "manifest-parts")
    before = F.sum("n").over(Window.partitionBy("key").orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    parts = parts.select("key", "part", F.coalesce(before, F.lit(0)).alias("before"))
    own = F.row_number().over(Window.partitionBy("key", "part").orderBy(*by))
    return rows.withColumn("own", own).join(small(parts), ["key", "part"]).withColumn("idx", (F.col("own") + F.col("before") - 1).cast("long")).drop("own", "before", "part")


def tree(leaves: DataFrame, depth: int) -> DataFrame:
    """Paths and roots of ``leaves`` (``key, idx, h``): ``key, idx, path, subroot``."""
    nodes, paths, number = leaves, None, 0
    while True:
        counts = small(materialise(nodes.groupBy("key").agg(F.count("*").alias("n")), "manifest-counts"))
        done = materialise(tier(nodes, counts, depth), f"manifest-tier{number}")
        up = done.groupBy("key", "bucket").agg(F.first("top").alias("h"))
        own = done.select("key", F.col("idx").alias(f"at{number}"), F.col("bucket").alias(f"at{number + 1}"), F.col("path").alias("more"), "top")
        if paths is None:
            paths = own.withColumnRenamed("more", "path").withColumnRenamed("top", "subroot").withColumn("idx", F.col("at0"))
        else:  # a bucket's path goes to all its leaves
            own = small(own, BROADCAST_ROWS // 10)
            paths = paths.drop("subroot").join(own.withColumnRenamed("top", "subroot"), ["key", f"at{number}"])
            paths = paths.withColumn("path", F.concat("path", "more")).drop("more")
        number += 1
        if not up.where("bucket > 0").limit(1).count():
            return paths.select("key", "idx", "path", "subroot")
        nodes = materialise(up.select("key", F.col("bucket").alias("idx"), "h"), f"manifest-nodes{number}")


def folded(leaf: Column, path: Column) -> Column:
    """The root that a leaf and its siblings give; a sibling begins with its side."""
    step = lambda h, s: F.sha2(F.when(s.startswith("L"), F.concat(F.substring(s, 2, 64), h)).when(s.startswith("R"), F.concat(h, F.substring(s, 2, 64))).otherwise(h), 256)
    return F.aggregate(path, leaf, step)


@leaves_nothing("manifest-result")
def manifest(rows: DataFrame, id_col: str, group_col: str, leaf: Column, checked: Column, depth: int = DEPTH) -> DataFrame:
    """Leaves, roots and proofs: ``id_col, leaf, subroot, root, path, proof_sha256, folded_root, verified``
    for every row.

    ``leaf`` is a row's digest, ``checked`` the digest that is folded up its path to see whether it
    still leads to the root. Leaves of a group ascend by id (null ids first, rows of one id by
    leaf); every two consecutive nodes become the digest of both, a last odd one that of itself,
    until one is left. Groups ascend bytewise, null first, and form the root alike. ``path`` has a
    sibling a level, from the bottom up: ``L`` or ``R`` for its side and its digest, or nothing where a
    node had none. Equal rows are equal leaves with paths of their own. No text leaves the scan; an
    empty table gives no rows and no root.
    """
    key = F.coalesce(F.concat(F.lit("v"), F.col(group_col).cast("string")), F.lit("n"))  # "n" comes before all "v..."
    leaves = numbered(rows.select(F.col(id_col).alias("id"), key.alias("key"), leaf.alias("h"), checked.alias("checked")), ["id", "h", "checked"])
    leaves = materialise(leaves, "manifest-leaves")
    inner = materialise(tree(leaves.select("key", "idx", "h"), depth), "manifest-inner")
    groups = inner.where("idx = 0").select(F.lit(TOP).alias("key"), F.col("key").alias("name"), F.col("subroot").alias("h"))
    groups = materialise(numbered(groups, ["name"]), "manifest-groups")
    outer = tree(groups.select("key", "idx", "h"), depth).withColumnRenamed("subroot", "root").withColumnRenamed("path", "outer")
    outer = materialise(outer.join(groups.select("idx", "name"), "idx").select(F.col("name").alias("key"), "outer", "root"), "manifest-outer")
    out = leaves.join(inner, ["key", "idx"]).join(small(outer), "key").withColumn("path", F.concat("path", "outer"))
    siblings = F.transform("path", lambda s: F.substring(s, 2, 64))
    out = out.withColumn("folded_root", folded(F.col("checked"), F.col("path"))).withColumn("proof_sha256", F.sha2(F.concat_ws("", siblings), 256))
    out = out.select("id", F.col("h").alias("leaf"), "subroot", "root", "path", "proof_sha256", "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))
    return out.withColumnRenamed("id", id_col)


def document_manifest(docs: DataFrame, depth: int = DEPTH) -> DataFrame:
    """The manifest of ``documents`` by language, checked after tampering: where 7 divides the CRC-32 of an
    id's decimal digits, one is added to ``n_chars`` (a null stays; a null id isn't tampered with)."""
    fields = [F.col(c) for c in ("doc_id", "source", "lang")]
    (one,) = fresh(docs, "tampered")
    tampered = F.when(F.crc32(F.col("doc_id").cast("string")) % 7 == 0, F.try_add(F.col("n_chars").cast("decimal(38,0)"), F.lit(1))).otherwise(F.col("n_chars").cast("decimal(38,0)"))
    docs = docs.withColumn(one, tampered)
    return manifest(docs, "doc_id", "lang", digest_of(*fields, F.col("n_chars"), F.col("text")), digest_of(*fields, F.col(one), F.col("text")), depth)


ORACLE = """
WITH RECURSIVE e AS (
  SELECT doc_id, lang, n_chars,
    coalesce(strlen(doc_id::VARCHAR) || ':' || doc_id, '-') || coalesce(strlen(source) || ':' || source, '-') || coalesce(strlen(lang) || ':' || lang, '-') AS head,
    coalesce(strlen(text) || ':' || text, '-') AS tail,
    list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(doc_id::VARCHAR, ''), lambda c: ascii(c)::BIGINT)),
      lambda a, b: list_reduce(list_prepend(xor(a, b), range(8)), lambda x, i: xor(x >> 1, 3988292384::BIGINT * (x & 1)))) AS crc
  FROM documents
), f AS (
  SELECT doc_id, lang, sha256(head || coalesce(strlen(n_chars::VARCHAR) || ':' || n_chars, '-') || tail) AS leaf,
    sha256(head || coalesce(strlen(m::VARCHAR) || ':' || m, '-') || tail) AS checked,
    row_number() OVER (PARTITION BY lang ORDER BY doc_id) - 1 AS idx, count(*) OVER (PARTITION BY lang) AS n
  FROM (SELECT *, n_chars + CASE WHEN xor(crc, 4294967295) % 7 = 0 THEN 1 ELSE 0 END AS m FROM e)
), lv AS (
  SELECT 0 AS level, lang, idx, n, leaf AS h FROM f
  UNION ALL
  SELECT level + 1, lang, idx // 2, (n + 1) // 2, sha256(string_agg(h, '' ORDER BY idx)) FROM lv WHERE n > 1 GROUP BY level, lang, idx // 2, n
), sub AS (
  SELECT lang, h AS subroot, row_number() OVER (ORDER BY lang NULLS FIRST) - 1 AS idx, count(*) OVER () AS n FROM lv WHERE n = 1
), up AS (
  SELECT 0 AS level, idx, n, subroot AS h FROM sub
  UNION ALL
  SELECT level + 1, idx // 2, (n + 1) // 2, sha256(string_agg(h, '' ORDER BY idx)) FROM up WHERE n > 1 GROUP BY level, idx // 2, n
), inner_path AS (
  SELECT f.lang, f.idx, list(CASE WHEN s.h IS NULL THEN '' WHEN (f.idx >> l.level) % 2 = 1 THEN 'L' || s.h ELSE 'R' || s.h END ORDER BY l.level) AS path
  FROM f JOIN (SELECT DISTINCT lang, level FROM lv WHERE n > 1) l ON f.lang IS NOT DISTINCT FROM l.lang
  LEFT JOIN lv s ON s.lang IS NOT DISTINCT FROM f.lang AND s.level = l.level AND s.idx = xor(f.idx >> l.level, 1::BIGINT)
  GROUP BY f.lang, f.idx
), outer_path AS (
  SELECT sub.lang, list(CASE WHEN s.h IS NULL THEN '' WHEN (sub.idx >> l.level) % 2 = 1 THEN 'L' || s.h ELSE 'R' || s.h END ORDER BY l.level) AS path
  FROM sub CROSS JOIN (SELECT DISTINCT level FROM up WHERE n > 1) l LEFT JOIN up s ON s.level = l.level AND s.idx = xor(sub.idx >> l.level, 1::BIGINT)
  GROUP BY sub.lang
), o AS (
  SELECT f.doc_id, f.leaf, f.checked, sub.subroot, (SELECT h FROM up WHERE n = 1) AS root, list_concat(coalesce(i.path, []), coalesce(p.path, [])) AS path
  FROM f JOIN sub ON f.lang IS NOT DISTINCT FROM sub.lang
  LEFT JOIN inner_path i ON f.lang IS NOT DISTINCT FROM i.lang AND f.idx = i.idx LEFT JOIN outer_path p ON f.lang IS NOT DISTINCT FROM p.lang
), g AS (
  SELECT *, sha256(array_to_string(list_transform(path, lambda s: s[2:]), '')) AS proof_sha256,
    list_reduce(list_prepend(checked, path), lambda h, s: sha256(CASE s[1] WHEN 'L' THEN s[2:] || h WHEN 'R' THEN h || s[2:] ELSE h END)) AS folded_root
  FROM o
)
SELECT doc_id, leaf, subroot, root, proof_sha256, folded_root, folded_root = root AS verified FROM g
"""
