"""Ownership of addresses by roots: an address lies under a root if it is the root or goes on with a slash.

Nothing is compared by prefix. Each address gives its ancestors (itself, and what stands before each
slash), and those meet the roots by hash. What is counted per root is first counted per address and per
ancestor, in partial sums, so that a root that owns most addresses is no hot key.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Rows of a table of roots that are broadcast at most; it is counted first.
BROADCAST_ROOTS = 50_000


def ancestors(uri: Column) -> Column:
    """All that an address may lie under, shortest first: every root that owns it is one of these."""
    parts = F.split(uri, "/")
    return F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, 1, n), "/"))


def base(root: Column) -> Column:
    """A root without slashes at its end."""
    return F.regexp_replace(root, "/+$", "")


def _prefix(strip: bool) -> Column:
    """What lies before the slash of all that a root owns; without ``strip`` a root is taken as it is written."""
    return base(F.col("root_uri")) if strip else F.col("root_uri")


def _distinct_roots(roots: DataFrame, strip: bool) -> DataFrame:
    own = roots.select("root_uri", _prefix(strip).alias("prefix")).where("root_uri is not null").distinct()
    return F.broadcast(own) if own.limit(BROADCAST_ROOTS + 1).count() <= BROADCAST_ROOTS else own


def owning_roots(addresses: DataFrame, roots: DataFrame, strip: bool = True) -> DataFrame:
    """Every root of every address: ``uri, root_uri``, once each. A null address has none. A root that ends in a slash
    owns what the same root without it does, unless ``strip`` is off: then it owns itself and what follows one more slash."""
    prefixes = addresses.select("uri").where("uri is not null").distinct().select("uri", F.explode(F.array_distinct(ancestors(F.col("uri")))).alias("prefix"))
    return prefixes.join(_distinct_roots(roots, strip), "prefix").select("uri", "root_uri")


def owner(addresses: DataFrame, roots: DataFrame, strip: bool = True) -> DataFrame:
    """The root that each address belongs to: the longest that owns it; ``uri, root_uri``."""
    return owning_roots(addresses, roots, strip).groupBy("uri").agg(F.max_by("root_uri", F.length("root_uri")).alias("root_uri"))


def per_root(rows: DataFrame, roots: DataFrame, value: Column, fold, again=None, strip: bool = True) -> DataFrame:
    """``fold(value)`` over the rows (``uri`` and what ``value`` needs) under each root: ``root_uri, v``, null
    for a root with none. ``again`` folds what was folded before (``fold``, if it isn't given)."""
    again = again or fold
    each = rows.where("uri is not null").groupBy("uri").agg(fold(value).alias("v"))
    prefixes = each.select(F.explode(F.array_distinct(ancestors(F.col("uri")))).alias("prefix"), "v").groupBy("prefix").agg(again(F.col("v")).alias("v"))
    return roots.select("root_uri", _prefix(strip).alias("prefix")).join(prefixes, "prefix", "left").select("root_uri", "v")


def references(links: DataFrame, nodes: DataFrame) -> DataFrame:
    """The addresses that references lead to, once for each reference: ``uri``. ``nodes`` has ``id`` and ``metadata``."""
    at = nodes.select(F.col("id").alias("target"), F.col("metadata")["uri"].alias("uri"))
    return links.where("relation = 'references_ov'").select("target").join(at, "target").select("uri")


def references_per_root(links: DataFrame, nodes: DataFrame, roots: DataFrame, strip: bool = True) -> DataFrame:
    """References to the documents under each root: ``root_uri, refs``."""
    found = per_root(references(links, nodes), roots, F.lit(1), F.sum, strip=strip)
    return found.select("root_uri", F.coalesce("v", F.lit(0)).cast("long").alias("refs"))


def references_per_owner(links: DataFrame, nodes: DataFrame, roots: DataFrame, strip: bool = True) -> DataFrame:
    """The same, but each document counts for its longest root alone: ``root_uri, refs``."""
    each = references(links, nodes).groupBy("uri").agg(F.count("*").alias("refs"))
    found = each.join(owner(each, roots, strip), "uri").groupBy("root_uri").agg(F.sum("refs").alias("refs"))
    return roots.select("root_uri").join(found, "root_uri", "left").select("root_uri", F.coalesce("refs", F.lit(0)).alias("refs"))


def top_scores(roots: DataFrame, hits: DataFrame, queries: int = 3, strip: bool = True) -> DataFrame:
    """The best score that the first ``queries`` searches found under each candidate root; null for
    roots that are enabled already (they aren't searched). ``hits`` has ``query_no, uri, score``."""
    rows = roots.join(per_root(hits.where(F.col("query_no") < queries), roots.where("not enabled"), F.col("score"), F.max, strip=strip), "root_uri", "left")
    return rows.select("root_uri", F.when(~F.col("enabled"), F.greatest(F.coalesce("v", F.lit(0.0)), F.lit(0.0))).alias("top_score"))


#: What may be decided about a root.
ACTIONS = ("keep", "enable", "disable", "remove")


@dataclass(frozen=True)
class Governed:
    """Roots after governance, the evidence it had, what became of each decision, and whether the
    set of enabled roots differs (one row)."""

    roots: DataFrame
    evidence: DataFrame
    log: DataFrame
    changed: DataFrame


def probe(roots: DataFrame, found: DataFrame, now: float) -> DataFrame:
    """Roots after a look at what is there (``found``: ``root_uri``): known ones were seen now, others come in
    switched off."""
    seen = found.select("root_uri").distinct().withColumn("_seen", F.lit(True))
    rows = roots.join(seen, "root_uri", "full")
    new = {"enabled": F.lit(False), "origin": F.lit("refine_probe"), "added_at": F.lit(now)}
    there = F.col("enabled").isNotNull()
    out = {c: F.when(there, F.col(c)).otherwise(v) for c, v in new.items() if c in roots.columns}
    if "last_seen" in roots.columns:
        out["last_seen"] = F.when(F.col("_seen"), F.lit(now)).otherwise(F.col("last_seen"))
    return rows.withColumns(out).select(*roots.columns)


def evidence(before: DataFrame, roots: DataFrame, found: DataFrame, links: DataFrame, nodes: DataFrame, hits: DataFrame, strip: bool = True) -> DataFrame:
    """What is known of each root: ``root_uri, refs, docs, top_score, is_new, there``. ``before`` are the roots before
    the probe; only roots that are switched off are searched for."""
    docs = nodes.select(F.col("metadata")["uri"].alias("uri"))
    out = references_per_root(links, nodes, roots, strip).join(per_root(docs, roots, F.lit(1), F.sum, strip=strip).withColumnRenamed("v", "docs"), "root_uri").join(top_scores(roots, hits, strip=strip), "root_uri")
    known = lambda df, c: df.select("root_uri").distinct().withColumn(c, F.lit(True))
    out = out.join(known(before, "_old"), "root_uri", "left").join(known(found, "_there"), "root_uri", "left")
    no = F.lit(False)
    return out.select("root_uri", "refs", F.coalesce("docs", F.lit(0)).cast("long").alias("docs"), "top_score", (~F.coalesce("_old", no)).alias("is_new"), F.coalesce("_there", no).alias("there"))


def govern(roots: DataFrame, found: DataFrame, decisions: DataFrame, links: DataFrame | None, nodes: DataFrame, hits: DataFrame, now: float, enable_cap: int = 1, strip: bool = True) -> Governed:
    """One round of governance: probe, evidence, decisions as a set.

    ``decisions`` has ``ord, root_uri, action``; they count in the order of ``ord``. Items without a root or with an
    action that isn't one of ``ACTIONS`` are no decisions. A root that isn't there, or that an earlier
    decision has removed, is skipped. Of the enabling ones that aren't skipped the first
    ``enable_cap`` count, also if their root was enabled before; others keep. Of several decisions on a root the last
    one that counts wins. If nothing was found, there is no graph (``links`` is None) or no decision is valid,
    all roots stay as the probe left them.
    """
    before = roots
    roots = probe(roots, found, now)
    known = evidence(before, roots, found, links, nodes, hits, strip) if links is not None else None
    said = decisions.select("ord", F.trim("root_uri").alias("root_uri"), "action").where((F.col("root_uri") != "") & F.col("action").isin(*ACTIONS))
    gone = said.where("action = 'remove'").groupBy("root_uri").agg(F.min("ord").alias("_gone"))
    there = roots.select("root_uri", F.lit(True).alias("_known"))
    log = said.join(there, "root_uri", "left").join(gone, "root_uri", "left")
    log = log.withColumn("skipped", F.col("_known").isNull() | F.coalesce(F.col("ord") > F.col("_gone"), F.lit(False)))
    first = log.where("action = 'enable' and not skipped").orderBy("ord").limit(enable_cap).select("ord", F.lit(True).alias("_first"))
    log = log.join(F.broadcast(first), "ord", "left")
    log = log.withColumn("done", F.when(F.col("skipped"), "skip").when((F.col("action") == "enable") & F.col("_first").isNull(), "keep").otherwise(F.col("action")))
    log = log.select("ord", "root_uri", "action", "done")
    if known is None or found.isEmpty():
        log = log.withColumn("done", F.lit("keep"))
    last = log.where("done in ('enable', 'disable')").groupBy("root_uri").agg(F.max_by("done", "ord").alias("_last"))
    removed = log.where("done = 'remove'").select("root_uri").distinct()
    after = roots.join(last, "root_uri", "left").join(removed, "root_uri", "left_anti")
    after = after.withColumn("enabled", F.coalesce(F.col("_last") == "enable", "enabled")).select(*roots.columns)
    both = roots.select("root_uri", F.col("enabled").alias("a")).join(after.select("root_uri", F.col("enabled").alias("b")), "root_uri", "full")
    changed = both.agg(F.coalesce(F.bool_or(~F.col("a").eqNullSafe(F.col("b"))), F.lit(False)).alias("changed"))
    return Governed(after, known if known is not None else roots.select("root_uri").where("false"), log, changed)
