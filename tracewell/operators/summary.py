"""Block summaries and tool summaries as DataFrame operators over the log."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracewell.functions import fct as J
from tracewell.functions import tools
from tracewell.operators import log


def final_summaries(turns: DataFrame) -> DataFrame:
    """``session_id, turn, hdl, fct`` of the last final row of every turn that has a summary."""
    fin = turns.where(log.is_fin() & (F.coalesce("fct", F.lit("")) != "")).groupBy("session_id", "turn").agg(F.max_by(F.struct("fct", "hdl"), "seq").alias("r"))
    return fin.select("session_id", "turn", "r.hdl", "r.fct")


def turn_entries(turns: DataFrame) -> DataFrame:
    """``session_id, turn, entry`` (JSON) of every turn whose last final row has a readable summary."""
    made = final_summaries(turns).select("session_id", "turn", J.udf(J.turn_entry)(F.col("turn"), F.col("hdl"), F.col("fct")).alias("entry"))
    return made.where("entry is not null")


def summarise_turns(turns: DataFrame, segments: DataFrame | Column) -> DataFrame:
    """``session_id, topic_id, summary, hollow`` of every block: :func:`summarise_blocks` of :func:`turn_entries`, where a turn's
    summary is read once, by the task that puts its block together. ``segments`` is a table (``session_id, turn, topic_id``), or an
    expression over a turn, which then needs no join; turns move once, by session."""

    @F.pandas_udf("summary string, hollow boolean")
    def run(places: pd.Series, names: pd.Series, said: pd.Series) -> pd.DataFrame:
        out = []
        for block in zip(places, names, said, strict=True):
            entries = [e for e in map(J.turn_entry, block[0].tolist(), block[1], block[2]) if e is not None]
            made = J.block_summary(entries) if entries else None
            out.append((None, None) if made is None else (json.dumps(made, ensure_ascii=False), J.is_hollow(made)))
        return pd.DataFrame(out, columns=["summary", "hollow"])

    rows = final_summaries(turns.where("session_id is not null and turn is not null").repartition("session_id"))
    rows = (rows.withColumn("topic_id", segments) if isinstance(segments, Column) else rows.join(segments, ["session_id", "turn"])).where("topic_id is not null")
    blocks = rows.groupBy("session_id", "topic_id").agg(F.array_sort(F.collect_list(F.struct("turn", "hdl", "fct"))).alias("es"))
    made = blocks.select("session_id", "topic_id", run("es.turn", "es.hdl", "es.fct").alias("s"))
    return made.select("session_id", "topic_id", "s.summary", "s.hollow").where("summary is not null")


def summarise_blocks(entries: DataFrame, segments: DataFrame) -> DataFrame:
    """``session_id, topic_id, summary`` (JSON) of every block, by the rules that need no model."""

    @F.pandas_udf("string")
    def run(lists: pd.Series) -> pd.Series:
        return pd.Series([json.dumps(J.block_summary([json.loads(x) for x in items]), ensure_ascii=False) for items in lists])

    rows = entries.join(segments.where("topic_id is not null"), ["session_id", "turn"])
    blocks = rows.groupBy("session_id", "topic_id").agg(F.array_sort(F.collect_list(F.struct("turn", "entry"))).alias("es"))
    return blocks.select("session_id", "topic_id", run(F.transform("es", lambda s: s["entry"])).alias("summary"))


def strands_of(summaries: DataFrame) -> DataFrame:
    """Work-lines of block summaries; a hollow block (``hollow``, else its summary tells) gives one of status skip."""
    line = "array<struct<hdl:string,turns:array<bigint>,ooda:struct<`现象与问题`:array<string>,`背景与约束`:array<string>,`决策与方案`:array<string>,`后续行动`:array<string>>>>"
    shape = f"struct<hdl:string,status:string,changes:array<string>,key_facts:array<string>,strands:{line}>"
    hollow = F.col("hollow") if "hollow" in summaries.columns else J.udf(lambda s: J.is_hollow(json.loads(s)), "boolean")(F.col("summary"))
    rows = summaries.select("session_id", "topic_id", F.from_json("summary", shape).alias("s"), hollow.alias("hollow"))
    rows = rows.select("session_id", "topic_id", "s", "hollow", F.posexplode_outer("s.strands").alias("k", "st")).where("not hollow or k is null or k = 0")
    return rows.select(
        "session_id", "topic_id", "k", F.coalesce("st.hdl", "s.hdl").alias("hdl"), "st.turns", "st.ooda", "s.changes", "s.key_facts",
        F.when(F.col("hollow"), "skip").otherwise(F.col("s.status")).alias("status"),
    )


def tool_summaries(calls: DataFrame) -> DataFrame:
    """``calls`` (``tool_name, args_json, result`` and keys) with ``fct`` and ``hdl``."""
    made = F.from_json(J.udf(tools.summarise)(F.col("tool_name"), F.col("args_json"), F.col("result")), "struct<fct:string,hdl:string>")
    return calls.withColumn("_s", made).select(*calls.columns, F.col("_s.fct").alias("fct"), F.col("_s.hdl").alias("hdl"))


def backfill_tools(turns: DataFrame) -> DataFrame:
    """Summary events for tool rows that have none, or whose summary is the raw answer still."""
    raw = F.coalesce("fct", F.lit("")) == ""
    raw = raw | (F.startswith(F.ltrim("fct"), F.lit("{")) & ~F.contains("fct", F.lit('"result_summary"')))
    calls = turns.where((F.col("role") == "tool") & raw).select(*log.KEY, "tool_name", "args_json", F.col("elm").alias("result"))
    return tool_summaries(calls).select(*log.KEY, "fct", "hdl")


def summaries_from_model(frames: DataFrame, outputs: DataFrame) -> DataFrame:
    """The stored summary and headline of each final row: ``session_id, turn, seq, fct, hdl``.

    ``outputs`` holds what a model said of a frame, if anything: affairs are read first, the older
    format next. Without readable output the question's own text stands in.
    """

    def build(output: str | None, question: str | None) -> dict:
        affairs = J.parse_affairs(output)
        if affairs:
            fct = J.build_affairs(affairs["affairs"])
        else:
            old, _ = J.parse_markup(output)
            fct = J.clean_increment(old) | {"_assemble_status": 0}
            if not fct["changes"] and question:
                fct = {"changes": [], "core_change": question[:100], "_assemble_status": 1}
        return {"fct": json.dumps(fct, ensure_ascii=False), "hdl": J.headline_of(fct)}

    rows = frames.join(outputs, ["session_id", "turn", "seq"], "left")
    made = F.from_json(J.udf(build)(F.col("output"), F.col("question")), "struct<fct:string,hdl:string>")
    return rows.withColumn("_s", made).select("session_id", "turn", "seq", F.col("_s.fct").alias("fct"), F.col("_s.hdl").alias("hdl"))


def think_context(cards: DataFrame, thoughts: DataFrame, questions: DataFrame, most: int = 2, chars: int = 800, budget: int = 1600) -> DataFrame:
    """What a summary prompt shows of a turn's reasoning: ``session_id, turn, context``.

    Orienting cards come before deciding ones; at most ``most``, each cut, all within the budget.
    """
    rank = F.when(F.col("card_kind") == "orient", 0).when(F.col("card_kind") == "decision", 1)
    rows = cards.withColumn("p", rank).where("p is not null").join(thoughts.select(*log.KEY, F.col("elm").alias("thought")), log.KEY, "left")
    text = F.coalesce(F.when(F.col("thought") != "", F.col("thought")), "preview", F.lit(""))
    cut = F.when(F.length(text) <= chars, text).otherwise(F.concat(F.left(text, F.lit(chars)), F.lit("…[截断]")))
    rows = rows.join(questions, ["session_id", "turn"], "left")
    asked = F.when(F.coalesce("question", F.lit("")) != "", F.concat(F.lit("问题: "), F.col("question"), F.lit("\n"))).otherwise("")
    block = F.concat(F.lit("[思考卡 "), F.col("card_kind"), F.lit("|seq="), F.col("seq").cast("string"), F.lit("]\n"), asked, F.lit("思考: "), cut)
    lists = rows.groupBy("session_id", "turn").agg(F.slice(F.array_sort(F.collect_list(F.struct("p", "seq", F.length(cut).alias("n"), block.alias("b")))), 1, most).alias("bs"))
    start = F.struct(F.lit(0).alias("used"), F.lit(False).alias("full"), F.expr("cast(array() as array<string>)").alias("out"))

    def step(a, x):
        over = a["full"] | ((a["used"] + x["n"] > budget) & (F.size(a["out"]) > 0)) | (x["n"] == 0)
        used = F.when(over, a["used"]).otherwise(a["used"] + x["n"])
        return F.struct(used.alias("used"), (a["full"] | ((x["n"] > 0) & over) | (used >= budget)).alias("full"), F.when(over, a["out"]).otherwise(F.concat(a["out"], F.array(x["b"]))).alias("out"))

    return lists.select("session_id", "turn", F.array_join(F.aggregate("bs", start, step, lambda a: a["out"]), "\n\n").alias("context"))


def background_summary(text):
    """The summary that background turns get without a model."""
    return F.to_json(F.struct(F.expr("cast(array() as array<string>)").alias("changes"), F.left(text, F.lit(100)).alias("core_change"), F.lit(0).alias("_assemble_status")))
