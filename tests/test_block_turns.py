"""Blocks whose turns' summaries are read where the block is put together."""

import json

from pyspark.sql import functions as F

from tracewell.functions import fct as J
from tracewell.operators import summary

SAID = [
    {"affairs": [{"hdl": "a", "ooda": {"现象与问题": ["x", "y"], "后续行动": ["z"]}}, {"hdl": "", "ooda": {"决策与方案": ["w"]}}]},
    {"changes": [{"stage_tag": "评估中", "core_change": "more"}, {"core_change": "less", "ooda": "决策与方案"}], "consensus": ["c"]},
    {"affairs": [{"hdl": "a", "ooda": {"现象与问题": ["y", "new"]}}, {"hdl": "empty", "ooda": {}}]},
    {"changes": [], "core_change": J.NO_NEWS},
]


def test_turns_summarised_at_once_are_as_by_entries(spark):
    fct = lambda i: "{" if i % 7 == 3 else json.dumps(SAID[i % 4], ensure_ascii=False)
    rows = [(str(i % 5) if i % 11 else None, i if i % 13 else None, k, "assistant", True, "stop", fct(i + k), ["", "head"][i % 2]) for i in range(60) for k in (0, 1)]
    turns = spark.createDataFrame([*rows, ("bad", 1, 0, "assistant", True, "stop", "{", "")], "session_id string, turn long, seq long, role string, is_fin boolean, finish_reason string, fct string, hdl string")
    topic = F.when(F.col("turn") % 9 > 0, F.floor(F.col("turn") / 20))
    entries = summary.turn_entries(turns)
    segments = turns.select("session_id", "turn", topic.alias("topic_id")).distinct()
    want = sorted(map(tuple, summary.strands_of(summary.summarise_blocks(entries, segments)).collect()), key=repr)
    for cut in (topic, segments):
        assert sorted(map(tuple, summary.strands_of(summary.summarise_turns(turns, cut)).collect()), key=repr) == want and len(want) > 20
    plan = summary.summarise_turns(turns, topic)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and plan.count("EvalPython") + plan.count("ArrowEvalPython") > 0


def test_a_long_block_takes_time_by_its_turns():
    lines = J.affair_strands([{"turn": t, "affairs": [{"hdl": "a", "ooda": {"现象与问题": [f"p{t}"]}}]} for t in range(30_000)])
    assert [len(x["turns"]) for x in lines] == [30_000] and lines[0]["ooda"]["现象与问题"][-1] == "p29999"
