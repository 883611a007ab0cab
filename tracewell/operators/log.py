"""Scans of the conversation log, and its upserts as folds over an append-only log of events."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracewell.sources.shared import numbered
from tracewell.sources.tables import CORE_COLUMNS

KEY = ["session_id", "turn", "seq"]


def is_fin() -> Column:
    return F.coalesce((F.col("role") == "assistant") & (F.col("finish_reason") == "stop"), F.lit(False))


# -- folds ---------------------------------------------------------------------------------------


def current_turns(events: DataFrame) -> DataFrame:
    """The current row of every key after all events, in the order of ``event_no``.

    A ``write`` event whose core columns equal the stored row's, and whose summary columns are null
    or equal to the stored ones, changes nothing. Any other replaces the row, summaries included.
    A ``summary`` event sets the two summary columns.

    As a write that repeats the core columns can still replace the summaries, a row's summaries are
    the last that were given since its core columns last changed: a repeat without summaries keeps
    them, a repeat with new ones sets them (a null in it then clears the other).
    """
    core = [c for c in CORE_COLUMNS if c in events.columns]
    order = Window.partitionBy(*KEY).orderBy("event_no")
    written = F.when(F.col("kind") == "write", F.xxhash64(*[F.coalesce(F.col(c).cast("string"), F.lit("\x00")) for c in core]))
    rows = events.withColumn("_core", written)
    before = F.last("_core", ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, -1))
    rows = rows.withColumn("_new", F.when((F.col("kind") == "write") & (before.isNull() | (F.col("_core") != before)), 1).otherwise(0))
    rows = rows.withColumn("_island", F.sum("_new").over(order))
    given = (F.col("kind") == "summary") | (F.col("_new") == 1) | F.col("fct").isNotNull() | F.col("hdl").isNotNull()
    kept = [c for c in events.columns if c in core or c == "written_at"]
    last = rows.groupBy(*KEY, "_island").agg(
        *[F.max_by(c, F.when(F.col("kind") == "write", F.col("event_no"))).alias(c) for c in kept],
        F.max_by(F.struct("fct", "hdl"), F.when(given, F.col("event_no"))).alias("_s"),
    )
    newest = last.where("_island > 0").groupBy(*KEY).agg(F.max_by(F.struct(*kept, "_s"), "_island").alias("r"))
    return newest.select(*KEY, *[F.col(f"r.{c}").alias(c) for c in kept], F.col("r._s.fct").alias("fct"), F.col("r._s.hdl").alias("hdl"))


def current_calls(events: DataFrame) -> DataFrame:
    """The current row of every model call. Counters are maxima, other columns the last value that
    isn't null, so the order of stream patches and responses doesn't matter to them. The status is
    that of the last event: completed or failed once a stream has finished or failed."""
    last = ["turn", "provider", "model", "messages_count", "input_chars", "tool_calls_json", "usage_json", "finish_kind", "duration_ms"]
    failure = F.when(F.col("error").isNotNull(), F.to_json(F.struct("error"))).otherwise(F.col("failure_json"))
    state = F.when(F.col("error").isNotNull(), "failed").when(F.col("finished"), "completed").when(~F.col("finished"), "failed").otherwise(F.col("status"))
    rows = events.withColumn("_failure", failure).withColumn("_state", state)
    there = lambda c: F.max_by(c, F.when(F.col(c).isNotNull(), F.col("event_no")))
    return rows.groupBy("session_id", "request_id").agg(
        *[there(c).alias(c) for c in last],
        *[F.coalesce(F.max(c), F.lit(0)).alias(c) for c in ("reasoning_chars", "text_chars", "chunk_count")],
        there("_failure").alias("failure_json"), F.coalesce(there("_state"), F.lit("streaming")).alias("status"),
    )


def current_cards(events: DataFrame) -> DataFrame:
    """Reasoning cards: seven columns are the last written, the others the first."""
    newest = ["card_kind", "call_id", "tool_name", "question_text", "raw_len", "preview", "updated_at"]
    others = [c for c in events.columns if c not in (*KEY, *newest, "event_no")]
    return events.groupBy(*KEY).agg(*[F.max_by(c, "event_no").alias(c) for c in newest], *[F.min_by(c, "event_no").alias(c) for c in others])


def latest(events: DataFrame, keys: list[str], order: str) -> DataFrame:
    """The last event of each key: replace on conflict."""
    values = [c for c in events.columns if c not in keys]
    picked = events.groupBy(*keys).agg(F.max_by(F.struct(*values), order).alias("v"))
    return picked.select(*keys, *[F.col(f"v.{c}").alias(c) for c in values])


def session_meta(events: DataFrame) -> DataFrame:
    """Per session and profile: the last turn and topic, and when it was first and last written."""
    return events.groupBy("session_id", "profile").agg(
        F.max_by("last_turn", "updated_at").alias("last_turn"), F.max_by("last_topic_id", "updated_at").alias("last_topic_id"),
        F.min("updated_at").alias("created_at"), F.max("updated_at").alias("updated_at"),
    )


def insert_or_ignore(new: DataFrame, existing: DataFrame, keys: list[str]) -> DataFrame:
    """The rows of ``new`` whose key isn't in ``existing``, one for each key."""
    return new.dropDuplicates(keys).join(existing.select(*keys).distinct(), keys, "left_anti")


# -- scans ---------------------------------------------------------------------------------------


def session_rows(turns: DataFrame, session: str) -> DataFrame:
    """A session in order; the filter reaches the files (and their partition, if so laid out)."""
    return turns.where(F.col("session_id") == session).orderBy("turn", "seq")


def turn_rows(turns: DataFrame, session: str, turn: int) -> DataFrame:
    """One turn of a session in order."""
    return turns.where((F.col("session_id") == session) & (F.col("turn") == turn)).orderBy("seq")


def summary_at(turns: DataFrame, session: str, turn: int, seq: int) -> DataFrame:
    """The summary of one row, empty if it has none; no row if there is no such row."""
    row = turns.where((F.col("session_id") == session) & (F.col("turn") == turn) & (F.col("seq") == seq))
    return row.select(F.coalesce("fct", F.lit("")).alias("fct"))


def thinking_rows(turns: DataFrame) -> DataFrame:
    """The rows of thought of every turn."""
    return turns.where("block_type = 'thinking'")


def first_thinking(turns: DataFrame) -> DataFrame:
    """The first row of thought of each turn: ``session_id, turn, seq``."""
    return thinking_rows(turns).groupBy("session_id", "turn").agg(F.min("seq").alias("seq"))


def tool_rows(turns: DataFrame) -> DataFrame:
    """The tools' rows of every turn."""
    return turns.where("role = 'tool'")


def call_of(calls: DataFrame, session: str, request: str) -> DataFrame:
    """The current row of one model call."""
    return calls.where((F.col("session_id") == session) & (F.col("request_id") == request))


def cards_of(cards: DataFrame, session: str) -> DataFrame:
    """A session's reasoning cards in order."""
    return cards.where(F.col("session_id") == session).orderBy("turn", "seq")


def first_timestamps(turns: DataFrame) -> DataFrame:
    """When each session began: ``session_id, first_ts``."""
    return turns.groupBy("session_id").agg(F.min("written_at").alias("first_ts"))


def latest_of(rows: DataFrame, by: str, profile: str | None = None) -> DataFrame:
    """The newest row (of a profile): the last session, the last refinement."""
    own = rows if profile is None else rows.where(F.col("profile") == profile)
    return own.orderBy(F.col(by).desc()).limit(1)


def append_numbered(existing: DataFrame, new: DataFrame, key: str, order: list[str]) -> DataFrame:
    """Rows appended to a table whose key counts up; new rows are numbered in a given order, however many they are."""
    top = existing.agg(F.coalesce(F.max(key), F.lit(0)).cast("long").alias("_top"))
    rows = numbered(new, order, "_k").crossJoin(F.broadcast(top))
    return existing.unionByName(rows.withColumn(key, F.col("_top") + F.col("_k")).drop("_top", "_k"), allowMissingColumns=True)


def next_places(turns: DataFrame, new: DataFrame) -> DataFrame:
    """``new`` rows (``session_id, turn, pos``) with the ``seq`` they get: after the turn's last row, in order of ``pos``."""
    top = turns.groupBy("session_id", "turn").agg(F.max("seq").alias("_top"))
    order = Window.partitionBy("session_id", "turn").orderBy("pos")
    rows = new.join(top, ["session_id", "turn"], "left")
    return rows.withColumn("seq", F.coalesce("_top", F.lit(-1)) + F.row_number().over(order)).drop("_top")


def previous_summary(turns: DataFrame) -> DataFrame:
    """For each turn, the summary of the final row of the turn numbered one less; empty if there is none."""
    fin = turns.where(is_fin()).groupBy("session_id", "turn").agg(F.max_by("fct", "seq").alias("fct"))
    back = fin.select("session_id", (F.col("turn") + 1).alias("turn"), F.col("fct").alias("prev_fct"))
    all_turns = turns.select("session_id", "turn").distinct()
    return all_turns.join(back, ["session_id", "turn"], "left").select("session_id", "turn", F.when(F.col("turn") > 0, F.coalesce("prev_fct", F.lit(""))).otherwise("").alias("prev_fct"))


def incremental_frames(turns: DataFrame, columns: tuple[str, ...] = ("role", "elm")) -> DataFrame:
    """For each final row, the rows of its frame: the turn's user rows, and those after the final
    row before it up to itself: ``session_id, turn, fin_seq, seq`` and ``columns``.

    Rows after one another carry the number of their frame, so no row is compared with others.
    """
    order = Window.partitionBy("session_id", "turn").orderBy("seq")
    rows = turns.withColumn("fin", F.when(is_fin(), F.col("seq")))
    rows = rows.withColumn("fin_seq", F.min("fin").over(order.rowsBetween(0, Window.unboundedFollowing)))
    own = rows.where("fin_seq is not null and role <> 'user'").select("session_id", "turn", "fin_seq", "seq", *columns)
    fins = rows.where("fin is not null").select("session_id", "turn", F.col("fin").alias("fin_seq"))
    users = rows.where("role = 'user'").select("session_id", "turn", "seq", *columns).join(fins, ["session_id", "turn"])
    return own.unionByName(users.select("session_id", "turn", "fin_seq", "seq", *columns))


def first_questions(turns: DataFrame) -> DataFrame:
    """The first user text of each turn."""
    return turns.where("role = 'user'").groupBy("session_id", "turn").agg(F.min_by("elm", "seq").alias("question"))


def block_first_query(turns: DataFrame, segments: DataFrame, chars: int = 500) -> DataFrame:
    """For each block, the start of the opening message of its earliest turn that has one."""
    opening = turns.where("seq = 0 and role = 'user' and trim(elm) <> ''").select("session_id", "turn", F.left(F.trim("elm"), F.lit(chars)).alias("q"))
    return segments.where("topic_id is not null").join(opening, ["session_id", "turn"]).groupBy("session_id", "topic_id").agg(F.min_by("q", "turn").alias("query"))


def tail_turns(turns: DataFrame, n: int = 2) -> DataFrame:
    """The last ``n`` turns of each session that have a user row."""
    users = turns.where("role = 'user'").select("session_id", "turn").distinct()
    order = Window.partitionBy("session_id").orderBy(F.col("turn").desc())
    return users.withColumn("k", F.row_number().over(order)).where(F.col("k") <= n).drop("k")


def max_turns(turns: DataFrame) -> DataFrame:
    return turns.groupBy("session_id").agg(F.max("turn").alias("max_turn"))


def global_turn_max(turns: DataFrame) -> DataFrame:
    """The sum over sessions of their last turn."""
    return max_turns(turns).agg(F.coalesce(F.sum("max_turn"), F.lit(0)).cast("long").alias("global_turn_max"))


def discover_sessions(turns: DataFrame, least_rows: int = 4, at_least_bytes: int | None = None) -> DataFrame:
    """Sessions of at least ``least_rows`` rows, and of so many bytes if the scan knows file sizes."""
    found = turns.groupBy("session_id").agg(F.count("*").alias("rows"))
    if at_least_bytes is not None:
        sized = turns.select("session_id", "_metadata.file_path", "_metadata.file_size").distinct()
        sized = sized.groupBy("session_id").agg(F.sum("file_size").alias("bytes")).where(F.col("bytes") >= at_least_bytes)
        found = found.join(sized.select("session_id"), "session_id", "left_semi")
    return found.where(F.col("rows") >= least_rows)


def merge_split_rows(turns: DataFrame) -> DataFrame:
    """Adjacent assistant rows of a turn that belong to one request (or none) become one: texts
    joined by an empty line, the first row's other columns. Gaps and islands, without a loop."""
    order = Window.partitionBy("session_id", "turn").orderBy("seq")
    req = F.coalesce("request_id", F.lit(""))
    rows = turns.withColumn("_r", req).withColumn("_pr", F.lag("_r").over(order)).withColumn("_prole", F.lag("role").over(order))
    joins = (F.col("role") == "assistant") & (F.col("_prole") == "assistant") & (F.col("_r") == F.col("_pr"))
    rows = rows.withColumn("_island", F.sum(F.when(F.coalesce(joins, F.lit(False)), 0).otherwise(1)).over(order))
    texts = [c for c in ("elm", "fct", "hdl") if c in turns.columns]
    others = [c for c in turns.columns if c not in (*KEY, *texts, "tool_calls_json")]
    calls = [F.min_by("tool_calls_json", F.when(F.col("tool_calls_json") != "", F.col("seq"))).alias("tool_calls_json")] if "tool_calls_json" in turns.columns else []
    joined = lambda c: F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.coalesce(F.col(c), F.lit("")) != "", F.struct("seq", c)))), lambda s: s[c]), "\n\n")
    return rows.groupBy("session_id", "turn", "_island").agg(F.min("seq").alias("seq"), *[joined(c).alias(c) for c in texts], *[F.min_by(c, "seq").alias(c) for c in others], *calls).drop("_island")


def missing_user_rows(turns: DataFrame, requests: DataFrame) -> DataFrame:
    """User texts of a request that the session's log doesn't hold yet, with the seq they get:
    ``session_id, turn, seq, elm``. ``requests`` has ``session_id, turn, pos, text``."""
    known = turns.where("role = 'user'").select("session_id", F.trim("elm").alias("t")).distinct()
    new = requests.withColumn("t", F.trim("text")).where("t <> ''")
    new = new.groupBy("session_id", "turn", "t").agg(F.min("pos").alias("pos")).join(known, ["session_id", "t"], "left_anti")
    top = turns.groupBy("session_id", "turn").agg(F.max("seq").alias("top"))
    order = Window.partitionBy("session_id", "turn").orderBy("pos")
    return new.join(top, ["session_id", "turn"], "left").select("session_id", "turn", (F.coalesce("top", F.lit(-1)) + F.row_number().over(order)).alias("seq"), F.col("t").alias("elm"))


def place_tool_results(turns: DataFrame, results: DataFrame) -> DataFrame:
    """Where a tool's result goes: the last placeholder of its call id, else a new row at the end:
    ``session_id, turn, seq, tool_call_id, elm, replaced``."""
    slots = turns.where("role = 'tool' and status = 'pending'").groupBy("session_id", "tool_call_id").agg(F.max(F.struct("turn", "seq")).alias("p"))
    top = turns.groupBy("session_id", "turn").agg(F.max("seq").alias("top"))
    rows = results.join(slots, ["session_id", "tool_call_id"], "left").join(top, ["session_id", "turn"], "left")
    order = Window.partitionBy("session_id", "turn", F.col("p").isNull()).orderBy("tool_call_id")
    seq = F.when(F.col("p").isNotNull(), F.col("p.seq")).otherwise(F.coalesce("top", F.lit(-1)) + F.row_number().over(order))
    return rows.select("session_id", F.coalesce("p.turn", "turn").alias("turn"), seq.alias("seq"), "tool_call_id", "elm", F.col("p").isNotNull().alias("replaced"))


# -- blocks and cards ----------------------------------------------------------------------------


def block_type(role: Column, has_calls: Column, has_reasoning: Column) -> Column:
    r = F.lower(F.trim(F.coalesce(role, F.lit(""))))
    return (
        F.when(r == "user", "user_message").when(r == "system", "system_message").when(r == "tool", "tool_call_result").when(r == "api_metadata", "api_metadata")
        .when((r == "assistant") & has_calls, "tool_call_request").when((r == "assistant") & has_reasoning, "thinking").when(r == "assistant", "agent_reply").otherwise("unknown")
    )


def ooda_stage(kind: Column) -> Column:
    return (
        F.when(kind == "user_message", "orient").when(kind.isin("thinking", "agent_reply"), "decide").when(kind == "tool_call_request", "act")
        .when(kind.isin("api_metadata", "system_message"), F.lit(None).cast("string")).otherwise("observe")
    )


def infer_provider(provider: Column, model: Column, base_url: Column) -> Column:
    """The provider that is given, else the first rule that the address or the model fits."""
    # Rules in order.
    rules = (("deepseek", "deepseek"), ("gpt-|o1|o3", "openai"), ("openai", "openai"), ("openrouter", "openrouter"), ("localhost|127\\.0\\.0\\.1", "local"), ("ollama", "ollama"), ("anthropic|claude", "anthropic"))
    base, name = F.lower(F.coalesce(base_url, F.lit(""))), F.lower(F.coalesce(model, F.lit("")))
    out = F.when(F.trim(provider) != "", F.trim(provider))
    for pattern, found in rules:
        out = out.when(base.rlike(pattern) | name.rlike(pattern), found)
    return out.otherwise("unknown")


def card_kind(raw_len: Column, has_calls: Column, fin: Column, tool_error: Column, correction: Column, first: Column, least: int = 800) -> Column:
    return (
        F.when(raw_len <= 0, None).when(has_calls, "decision").when(fin & ((raw_len >= least) | tool_error | correction), "conclusion").when(first, "orient")
    )


def tool_errors(turns: DataFrame) -> DataFrame:
    """Turns with a tool row that failed: ``session_id, turn``."""
    bad = (F.col("status").isNotNull() & ~F.col("status").isin("ok", "pending")) | (F.coalesce("error_text", F.lit("")) != "")
    return turns.where((F.col("role") == "tool") & bad).select("session_id", "turn").distinct()


def frames(turns: DataFrame) -> DataFrame:
    """A turn as text, line by line: ``session_id, turn, frame``."""
    kind = F.col("block_type") if "block_type" in turns.columns else F.lit(None).cast("string")
    tool = F.col("tool_name") if "tool_name" in turns.columns else F.lit(None).cast("string")
    named = F.coalesce(tool, F.lit(""))
    text = F.coalesce("elm", F.lit(""))
    plain = F.when(F.col("role") == "user", F.concat(F.lit("User: "), text)).when(F.col("role") == "tool", F.concat(F.lit("Tool("), named, F.lit("): "), F.left(text, F.lit(200)))).otherwise(F.concat(F.lit("Assistant: "), text))
    prefix = F.concat(F.lit("["), F.coalesce(ooda_stage(kind), F.lit("None")), F.lit("|"), kind, F.lit("] "))
    own = F.when(kind == "tool_call_result", F.concat(F.when(named != "", F.concat(named, F.lit(": "))).otherwise(""), F.left(text, F.lit(200)))).when(kind == "tool_call_request", named).otherwise(F.concat(text, F.when((kind == "agent_reply") & is_fin(), " (fin)").otherwise("")))
    line = F.when(kind.isNotNull(), F.concat(prefix, own)).otherwise(plain)
    lines = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seq", line.alias("line")))), lambda s: s["line"]), "\n")
    return turns.groupBy("session_id", "turn").agg(lines.alias("body")).select("session_id", "turn", F.concat(F.lit("[事务 #"), F.col("turn").cast("string"), F.lit("]\n"), "body").alias("frame"))
