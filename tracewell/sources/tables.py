"""Schemas of the engine's tables, and the driver's tables read as such."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: The conversation log: one event a row; the current row of a key is a fold over its events.
CORE_COLUMNS = (
    "role", "elm", "tool_name", "tool_call_id", "args_json", "status", "duration_ms", "tool_calls_json", "finish_reason", "usage_prompt_tokens",
    "usage_completion_tokens", "biz_category", "block_type", "ooda_stage", "request_id", "provider", "model", "reasoning_chars", "text_chars",
    "result_chars", "error_text", "is_fin", "metadata_incomplete",
)
TURN_LOG = (
    "session_id string, turn bigint, seq bigint, role string, elm string, tool_name string, tool_call_id string, args_json string, status string, "
    "duration_ms bigint, tool_calls_json string, finish_reason string, usage_prompt_tokens bigint, usage_completion_tokens bigint, biz_category string, "
    "block_type string, ooda_stage string, request_id string, provider string, model string, reasoning_chars bigint, text_chars bigint, "
    "result_chars bigint, error_text string, is_fin bigint, metadata_incomplete bigint, fct string, hdl string, written_at double"
)
LLM_CALLS = (
    "session_id string, request_id string, event_no bigint, kind string, turn bigint, provider string, model string, messages_count bigint, input_chars bigint, "
    "reasoning_chars bigint, text_chars bigint, chunk_count bigint, tool_calls_json string, usage_json string, finish_kind string, duration_ms bigint, "
    "failure_json string, status string, finished boolean, error string"
)
OODA = "struct<`现象与问题`:array<string>,`背景与约束`:array<string>,`决策与方案`:array<string>,`后续行动`:array<string>>"
STRANDS = (
    f"strand_id bigint, session_id string, topic_id bigint, profile string, hdl string, turns array<bigint>, ooda {OODA}, changes array<string>, "
    "key_facts array<string>, centroid array<double>, status string, created_at double"
)
STATUS = "struct<current_state:array<string>,key_facts:array<string>,goals:array<string>,context:array<string>>"
TIMELINE = "array<struct<seq:bigint,topic_id:bigint,turns:array<bigint>,session_id:string,overview:string,hdl:string,changes:array<string>,ts:double>>"
REALITIES = (
    f"reality_id bigint, name string, hdl string, current_status {STATUS}, timeline {TIMELINE}, source_strands map<string,array<bigint>>, profile string, "
    "centroid array<double>, query_centroid array<double>, query_count bigint, updated_at double, created_at double"
)
NODES = "id string, label string, norm_label string, file_type string, source_file string, _origin string, community bigint, metadata map<string,string>"
LINKS = "source string, target string, relation string, confidence string, confidence_score double, source_file string, source_location string, weight double"
STRAND_MAP = "strand_id bigint, reality_id bigint"
COOCCURRENCES = "session_id string, topic_id bigint, profile string, reality_a bigint, reality_b bigint, created_at double"
THEMES = (
    f"theme_id bigint, title string, overview string, ooda {OODA}, key_facts array<string>, open_items array<string>, timeline {TIMELINE}, changes array<string>, "
    "centroid array<double>, source_strands map<string,array<bigint>>, profile string, created_at double, updated_at double"
)
ROOTS = "root_uri string, filters struct<include:array<string>,exclude:array<string>>, enabled boolean, origin string, added_at double, last_seen double"


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def json_or_null(text: Column, schema: str) -> Column:
    """Parsed JSON; malformed text, and the literal ``null``, give null, never an error."""
    return F.from_json(F.when(F.trim(text) != "null", text), schema, {"mode": "PERMISSIVE"})


def turn_log(conversations: DataFrame) -> DataFrame:
    """Conversations as a log: a user's message opens a turn (1, 2, ...) at seq 0, and what follows
    is at seq 1, 2, ...; the last assistant row of a turn is its final one. System rows, and what
    comes before the first user's message, are left out. A final row's summary is its text."""
    session = Window.partitionBy("conv_id").orderBy("turn", "text")
    rows = conversations.where("role <> 'system'").withColumn("ordinal", F.sum(F.when(F.col("role") == "user", 1).otherwise(0)).over(session))
    rows = rows.where("ordinal > 0")
    inner = Window.partitionBy("conv_id", "ordinal").orderBy("turn", "text")
    rows = rows.withColumn("seq", F.row_number().over(inner) - 1)
    last = F.max(F.when(F.col("role") == "assistant", F.col("seq"))).over(Window.partitionBy("conv_id", "ordinal"))
    fin = (F.col("role") == "assistant") & (F.col("seq") == last)
    return rows.select(
        F.col("conv_id").cast("string").alias("session_id"), F.col("ordinal").cast("long").alias("turn"), F.col("seq").cast("long").alias("seq"), "role",
        F.coalesce("text", F.lit("")).alias("elm"), F.when(fin, "stop").alias("finish_reason"),
        F.when(F.col("role") == "user", F.col("text")).otherwise(F.when(fin, F.col("text"))).alias("fct"),
        F.left("text", F.lit(100)).alias("hdl"), F.lit(None).cast("string").alias("biz_category"), F.lit(None).cast("string").alias("request_id"),
    )


def stream_events(events: DataFrame) -> DataFrame:
    """Events as stream deltas of model calls: the user is the session, the hour its request, the
    type decides the kind of delta and the value its length."""
    ts = F.col("ts").cast("timestamp")
    kind = F.element_at(F.split("event_type", ""), 1)
    return events.select(
        F.col("user_id").cast("string").alias("session_id"), F.date_format(F.date_trunc("day", ts), "yyyyMMdd").alias("request_id"), "event_id", ts.alias("ts"),
        F.when(F.pmod(F.ascii(kind), F.lit(2)) == 0, "reasoning").otherwise("text").alias("kind"), F.floor(F.abs("value")).cast("long").alias("chars"), "event_type",
    )


# -- stored tables with JSON columns --------------------------------------------------------------

_STRINGS, _SOURCES = "array<string>", "map<string,array<bigint>>"


def _list(column: str, schema: str = _STRINGS) -> Column:
    return F.coalesce(json_or_null(F.col(column), schema), F.expr(f"cast(array() as {schema})")).alias(re.sub("_json$", "", column))


def _map(column: str) -> Column:
    return F.coalesce(json_or_null(F.col(column), _SOURCES), F.expr(f"cast(map() as {_SOURCES})")).alias(column)


def load_strands(stored: DataFrame, session: str | None = None, discarded: bool = False) -> DataFrame:
    """Work-lines with their JSON columns decoded, of one session or all. Malformed lists are empty.
    ``discarded`` lets those in that a pilot has set aside."""
    rows = stored if session is None else stored.where(F.col("session_id") == session)
    if not discarded and "status" in rows.columns:
        rows = rows.where("not status <=> 'discarded'")
    kept = [c for c in rows.columns if not c.endswith("_json") and c != "turns"]
    decoded = {"ooda_json": json_or_null(F.col("ooda_json"), OODA).alias("ooda"), "centroid_json": json_or_null(F.col("centroid_json"), "array<double>").alias("centroid")}
    lists = [_list(c) for c in ("changes_json", "key_facts_json") if c in rows.columns]
    return rows.select(*kept, _list("turns", "array<bigint>"), *[v for k, v in decoded.items() if k in rows.columns], *lists)


def load_realities(stored: DataFrame) -> DataFrame:
    """Work objects with their five JSON columns decoded; what is malformed is empty, a vector null."""
    kept = [c for c in stored.columns if not c.endswith("_json") and c != "source_strands"]
    return stored.select(
        *kept, json_or_null(F.col("current_status_json"), STATUS).alias("current_status"), _list("timeline_json", TIMELINE), _map("source_strands"),
        json_or_null(F.col("centroid_json"), "array<double>").alias("centroid"), json_or_null(F.col("query_centroid_json"), "array<double>").alias("query_centroid"),
    )


def load_themes(stored: DataFrame) -> DataFrame:
    """Themes with their JSON columns decoded, by the same rules."""
    kept = [c for c in stored.columns if not c.endswith("_json") and c != "source_strands"]
    return stored.select(
        *kept, json_or_null(F.col("ooda_json"), OODA).alias("ooda"), *[_list(f"{c}_json") for c in ("key_facts", "open_items", "changes")], _list("timeline_json", TIMELINE),
        _map("source_strands"), json_or_null(F.col("centroid_json"), "array<double>").alias("centroid"),
    )


def load_roots(stored: DataFrame) -> DataFrame:
    """Roots of documents with their filters decoded; filters that are no object filter nothing."""
    shape = "struct<include:array<string>,exclude:array<string>>"
    none = F.expr("cast(array() as array<string>)")
    f = json_or_null(F.col("filters"), shape)
    return stored.withColumn("filters", F.struct(F.coalesce(f["include"], none).alias("include"), F.coalesce(f["exclude"], none).alias("exclude")))


def enabled_roots(stored: DataFrame, pinned: str) -> DataFrame:
    """Enabled roots, ``pinned`` first, then by address."""
    return load_roots(stored.where("enabled")).orderBy(F.when(F.col("root_uri") == pinned, 0).otherwise(1), "root_uri")


#: Names under which an answer may hold its list of entries.
ENTRY_KEYS = ("entries", "items", "nodes", "files", "data")


def tree_entries(payload: Column) -> Column:
    """The entries (JSON texts) of a document tree's answer: the answer itself if it is a list, else
    the first list under a known name, there or in ``result``, else ``result`` if that is a list."""
    entries = lambda text: F.filter(F.from_json(F.when(F.trim(text).startswith("["), text), "array<string>"), lambda e: F.startswith(F.trim(e), F.lit("{")))
    paths = [f"$.{k}" for k in ENTRY_KEYS] + [f"$.result.{k}" for k in ENTRY_KEYS] + ["$.result"]
    none = F.expr("cast(array() as array<string>)")
    return F.coalesce(entries(payload), *[entries(F.get_json_object(payload, p)) for p in paths], none)
