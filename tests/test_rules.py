"""Rules of segmentation, folds, graph, merging and upkeep on small fixtures."""

import math
import random

import pytest
from pyspark.sql import functions as F

from tracewell.config import Config, load
from tracewell.functions import fct as J
from tracewell.functions import text as T
from tracewell.functions import tools
from tracewell.functions import vector as V
from tracewell.operators import docs, graph, history, log, merge, recall, refine, search, summary, topics
from tracewell.sources import tables as S
from tracewell.streaming.segmentation import Session


def one(spark, column, **values):
    return spark.range(1).select(*[F.lit(v).alias(k) for k, v in values.items()]).select(column.alias("x")).first().x


def turns(spark, messages, fcts=None, tokens=None):
    rows = [("s", i + 1, m, (fcts or {}).get(i + 1), (tokens or {}).get(i + 1, 0)) for i, m in enumerate(messages)]
    return spark.createDataFrame(rows, "session_id string, turn long, message string, fct string, total_tokens long")


def topics_of(spark, *args, **kw):
    return [(r.topic_id, r.is_switch) for r in topics.segment(turns(spark, *args, **kw)).orderBy("turn").collect()]


def test_forced_phrase_opens_a_topic(spark):
    assert topics_of(spark, ["tell me about invoices please", "more invoices about that please", "moving on to billing invoices"], {1: "tell me about invoices please"}) == [(1, False), (1, False), (2, True)]


def test_short_message_goes_on(spark):
    assert topics_of(spark, ["how do database indexes work", "ok", "继续", "database indexes again"], {1: "how do database indexes work"}) == [(1, False), (1, False), (1, False), (1, False)]


def test_empty_message_leaves_no_topic_open(spark):
    assert topics_of(spark, ["how do database indexes work", "", "database indexes again"], {1: "how do database indexes work"}) == [(1, False), (None, False), (2, False)]


def test_turn_zero_has_no_topic(spark):
    rows = spark.createDataFrame([("s", 0, "words here now", "words here now"), ("s", 1, "words here now", "words here now")], "session_id string, turn long, message string, fct string")
    assert [r.topic_id for r in topics.segment(rows).orderBy("turn").collect()] == [None, 1]


def test_pair_across_a_joint_counts(spark):
    # 甲 ends the profile and 乙 begins the appended text: only their pair is shared later.
    fcts = {1: "xx yy 甲", 2: "xx yy 乙", 3: "甲乙"}
    assert topics_of(spark, ["message one", "message two", "message three"], fcts) == [(1, False)] * 3


def test_pressure(spark):
    got = [one(spark, topics.water_pressure(F.col("n")), n=n) for n in (5_000, 12_500, 20_000, 90_000)]
    assert got == pytest.approx([0.0, 0.15, 0.30, 0.30])
    text = "alpha beta gamma delta"
    assert topics_of(spark, [text, text], {1: text, 2: text}, {2: 20_000}) == [(1, False), (1, False)]
    far = "alpha one two three four five six seven"
    assert topics_of(spark, [text, far], {1: text, 2: far}, {2: 20_000})[1] == (2, True)


def test_stream_state_equals_batch(spark):
    rng = random.Random(5)
    words = ["alpha", "beta", "gamma", "数据", "库", "设计", "moving on", "ok", "delta x", ""]
    sessions = {f"s{k}": [" ".join(rng.choice(words) for _ in range(rng.randint(0, 4))) for _ in range(12)] for k in range(6)}
    rows = [(s, i + 1, m, m) for s, ms in sessions.items() for i, m in enumerate(ms)]
    got = {(r.session_id, r.turn): (r.topic_id, r.is_switch) for r in topics.segment(spark.createDataFrame(rows, "session_id string, turn long, message string, fct string")).collect()}
    for s, ms in sessions.items():
        state = Session()
        for i, m in enumerate(ms):
            state = Session.load(state.dump())
            assert state.take(i + 1, m, m or None) == got[s, i + 1], (s, i, m)
            assert state.take(i + 1, m) is None  # a replay changes nothing


def test_radius_grades(spark):
    def grade(d, **kw):
        a = math.acos(1 - d)
        cols = {"max_intra": 0.4, "nearest": 0.0, "bg": False} | kw
        return one(spark, topics.radius_grade(F.array(F.lit(1.0), F.lit(0.0)), F.array(F.lit(math.cos(a)), F.lit(math.sin(a))), F.col("max_intra"), F.col("nearest"), F.col("bg")), **cols)

    assert [grade(0.19), grade(0.3), grade(0.45)] == ["Act", "Rel", "Far"]
    assert grade(0.3, nearest=0.2) == "Far" and grade(0.04, nearest=0.2) == "Act" and grade(0.0, bg=True) == "Far"


def test_replayed_write_keeps_summaries(spark):
    base = {"session_id": "s", "turn": 1, "seq": 0}
    events = [base | {"event_no": n, "kind": k, "role": "user", "elm": e, "fct": f, "hdl": h, "written_at": float(n)} for n, k, e, f, h in [(1, "write", "a", None, None), (2, "summary", None, "F", "H"), (3, "write", "a", None, None)]]
    shape = "session_id string, turn long, seq long, event_no long, kind string, role string, elm string, fct string, hdl string, written_at double"
    now = log.current_turns(spark.createDataFrame(events, shape)).first()
    assert (now.elm, now.fct, now.hdl) == ("a", "F", "H")
    changed = [*events, base | {"event_no": 4, "kind": "write", "role": "user", "elm": "b", "fct": None, "hdl": None, "written_at": 4.0}]
    now = log.current_turns(spark.createDataFrame(changed, shape)).first()
    assert (now.elm, now.fct, now.hdl) == ("b", None, None)


def test_calls_fold_the_same_in_any_order(spark):
    patch = {"kind": "patch", "reasoning_chars": 10, "text_chars": 5, "chunk_count": 3, "model": "m"}
    answer = {"kind": "response", "status": "completed", "messages_count": 7, "model": "m"}
    seen = set()
    for order in ((patch, answer), (answer, patch)):
        rows = [{"session_id": "s", "request_id": "r", "event_no": i} | x for i, x in enumerate(order)]
        now = log.current_calls(spark.createDataFrame(rows, S.LLM_CALLS)).first()
        seen.add((now.reasoning_chars, now.text_chars, now.chunk_count, now.messages_count, now.status, now.model))
    assert seen == {(10, 5, 3, 7, "completed", "m")}


def test_frames_split_at_final_rows(spark):
    rows = [("s", 1, i, r, f, f"t{i}") for i, (r, f) in enumerate([("user", None), ("assistant", None), ("assistant", "stop"), ("tool", None), ("assistant", "stop")])]
    got = log.incremental_frames(spark.createDataFrame(rows, "session_id string, turn long, seq long, role string, finish_reason string, elm string")).collect()
    assert sorted((r.fin_seq, r.seq) for r in got) == [(2, 0), (2, 1), (2, 2), (4, 0), (4, 3), (4, 4)]


def test_split_rows_of_a_request_merge(spark):
    rows = [("s", 1, 0, "user", None, "q", None), ("s", 1, 1, "assistant", "r1", "think", "[1]"), ("s", 1, 2, "assistant", "r1", "say", None), ("s", 1, 3, "assistant", "r2", "more", None)]
    got = log.merge_split_rows(spark.createDataFrame(rows, "session_id string, turn long, seq long, role string, request_id string, elm string, tool_calls_json string")).orderBy("seq").collect()
    assert [(r.elm, r.tool_calls_json) for r in got] == [("q", None), ("think\n\nsay", "[1]"), ("more", None)]


def test_missing_users_and_tool_results(spark):
    t = spark.createDataFrame([("s", 1, 0, "user", "hello", None, None), ("s", 1, 1, "tool", "", "c1", "pending")], "session_id string, turn long, seq long, role string, elm string, tool_call_id string, status string")
    req = spark.createDataFrame([("s", 1, 0, " hello "), ("s", 1, 1, "new text"), ("s", 1, 2, "new text")], "session_id string, turn long, pos long, text string")
    assert [(r.seq, r.elm) for r in log.missing_user_rows(t, req).collect()] == [(2, "new text")]
    res = spark.createDataFrame([("s", 1, "c1", "out"), ("s", 1, "c9", "lost")], "session_id string, turn long, tool_call_id string, elm string")
    assert sorted((r.tool_call_id, r.seq, r.replaced) for r in log.place_tool_results(t, res).collect()) == [("c1", 1, True), ("c9", 2, False)]


def test_blocks_providers_cards(spark):
    kind = lambda r, c=False, t=False: one(spark, log.block_type(F.lit(r), F.lit(c), F.lit(t)))
    assert [kind("user"), kind("assistant", True), kind("assistant", False, True), kind("assistant"), kind("x")] == ["user_message", "tool_call_request", "thinking", "agent_reply", "unknown"]
    who = lambda p, m, b: one(spark, log.infer_provider(F.lit(p), F.lit(m), F.lit(b)))
    assert [who(" own ", "x", ""), who(None, "gpt-9", ""), who("", "x", "http://localhost"), who(None, "y", None)] == ["own", "openai", "local", "unknown"]
    card = lambda n, c, f, e, k, first: one(spark, log.card_kind(*map(F.lit, (n, c, f, e, k, first))))
    assert [card(0, True, True, True, True, True), card(9, True, False, False, False, False), card(800, False, True, False, False, True), card(9, False, True, False, False, True), card(9, False, False, False, False, False)] == [None, "decision", "conclusion", "orient", None]


def test_history_grid(spark):
    rows = []
    for t in (1, 2, 3, 4):
        rows += [("s", t, 0, "user", None, f"u{t}", f"uf{t}", f"uh{t}", None), ("s", t, 1, "assistant", None, f"a{t}", f"af{t}", f"ah{t}", None), ("s", t, 2, "assistant", "stop", f"f{t}", f"ff{t}", "", None)]
    rows.append(("s", 1, 3, "assistant", None, "bg", None, None, "bg_review"))
    t = spark.createDataFrame(rows, "session_id string, turn long, seq long, role string, finish_reason string, elm string, fct string, hdl string, biz_category string")
    g = spark.createDataFrame([("s", 1, "Far"), ("s", 2, "Rel"), ("s", 3, "Far")], "session_id string, turn long, grade string")
    got = [m.content for m in history.assemble(t, g).first().messages]
    assert got == ["uh1", "略", "uf2", "ah2", "ff2", "u3", "a3", "f3", "u4", "a4", "f4"]


def test_rendered_summaries():
    assert history.render_fct('{"affairs":[{"hdl":"h","ooda":{"后续行动":["x"]}}]}', "user") == "# 事务1 h\n- 后续行动：x"
    assert history.render_fct('{"changes":[{"core_change":"c","stage_tag":"计划","ooda":"决策与方案"},{"change":"d"}]}', "user") == "# 决策与方案\n- [计划] c\n\n# 其他\n- d"
    assert history.render_fct('{"core_change":"c","error":null,"n":0}', "tool") == "c" and history.render_fct("plain", "user") == "plain"


def test_bm25_counts_repeated_query_tokens(spark):
    c = spark.createDataFrame([(1, "cat dog"), (2, "cat cat bird"), (3, " ")], "k long, t string")
    q = spark.createDataFrame([(1, "cat cat")], "q long, t string")
    got = {r.doc: r.score for r in search.bm25_scores(c, q, "k", "t", "q", "t").collect()}
    idf = math.log(1 + 0.5 / 2.5)
    want = {1: 2 * idf * 2.5 / (1 + 1.5 * (0.25 + 0.75 * 2 / 2.5)), 2: 2 * idf * 2 * 2.5 / (2 + 1.5 * (0.25 + 0.75 * 3 / 2.5))}
    assert got == pytest.approx(want)


def test_tokens_and_wide_space(spark):
    assert one(spark, T.tokens(F.lit("Ab_1 数据\u3000库 é!"))) == ["ab_1", "数", "据", "库", "é"]


def test_allocation_and_fusion(spark):
    slots = lambda b, v, k: tuple(one(spark, search.allocation(F.lit(b), F.lit(v), F.lit(k))))
    assert [slots(5, 9, 10), slots(2, 9, 10), slots(0, 3, 10), slots(9, 9, 4)] == [(6, 4), (4, 6), (2, 3), (4, 0)]
    rows = spark.createDataFrame([(1, 0, 0, "a"), (1, 0, 1, "b"), (1, 1, 0, "c"), (1, 1, 1, "a")], "q long, list int, rank int, doc string")
    assert [r.doc for r in search.fuse(rows).orderBy("rank").collect()] == ["a", "c", "b"] or [r.doc for r in search.fuse(rows).orderBy("rank").collect()][0] == "a"


def test_cosine_edges(spark):
    cos = lambda a, b: one(spark, V.cosine(F.array(*map(F.lit, a)), F.array(*map(F.lit, b))))
    assert cos([1.0, 0.0], [1.0, 0.0]) == 1.0 and cos([0.0, 0.0], [1.0, 0.0]) == 0.0 and cos([1.0], [1.0, 0.0]) == 0.0


def test_cooccurrences_are_recorded_once(spark):
    m = spark.createDataFrame([("s1", 1, "p", x) for x in (3, 1, 2, 2)] + [("s2", 1, "p", 1), ("s2", 1, "p", 2), ("s3", 1, "p", 9)], "session_id string, topic_id long, profile string, reality_id long")
    empty = spark.createDataFrame([], S.COOCCURRENCES)
    first = graph.record_cooccurrences(m.where("session_id = 's1'"), empty)
    assert first.count() == 3 and graph.record_cooccurrences(m.where("session_id = 's1'"), first).count() == 0
    assert graph.record_cooccurrences(m, first).count() == 1
    e = graph.edges(graph.block_pairs(m).withColumn("created_at", F.lit(0.0)))
    assert {(r.a, r.b): r.w for r in e.collect()} == {(1, 2): 2, (1, 3): 1, (2, 3): 1}


def test_s_candidates(spark):
    works, e = spark.createDataFrame([(1,), (2,), (3,), (4,)], "id long"), spark.createDataFrame([(1, 2, 1), (2, 3, 1)], "a long, b long, w long")
    a = spark.createDataFrame([(1, 1, False)], "q long, id long, fused boolean")
    assert [(r.id, r.s) for r in merge.s_candidates(works, a, e).orderBy("rank").collect()] == [(1, 0.0), (2, 0.5)]
    a = spark.createDataFrame([(1, 1, False), (1, 3, True)], "q long, id long, fused boolean")
    assert [r.id for r in merge.s_candidates(works, a, e).orderBy("rank").collect()] == [1, 3, 2]


def test_decisions_resolve(spark):
    s = spark.createDataFrame([(1,), (2,), (3,), (4,)], "strand_id long")
    c = spark.createDataFrame([(1, 10, 1), (1, 11, 2), (2, 10, 1), (3, 10, 1)], "strand_id long, id long, rank int")
    d = spark.createDataFrame([(1, "merge", 1), (2, "merge", 5), (4, "merge", 0)], "strand_id long, action string, target long")
    assert {r.strand_id: (r.action, r.target_id) for r in merge.resolve(s, c, d).collect()} == {1: ("merge", 11), 2: ("new", None), 3: ("new", None), 4: ("new", None)}


def test_sections_keep_anchor_rich_items(spark):
    items = ["纯文字", "one Anchor_name here 2024-01-02", "又一条", "see path/to/file.py and Other_name", "更多", "last"]
    assert one(spark, merge.by_anchor_wealth(F.array(*map(F.lit, items)), 3))[:2] == [items[3], items[1]] or set(one(spark, merge.by_anchor_wealth(F.array(*map(F.lit, items)), 3))[:2]) == {items[1], items[3]}
    arr = lambda *x: F.array(*map(F.lit, x))
    assert one(spark, merge.anchor_coverage(arr("Alpha_x Beta_y"), arr("alpha_x"))) == 0.5
    assert one(spark, merge.merge_guard(arr("a1", "b", "c", "d"), arr("a1"))) == "trivial_shrink"
    assert one(spark, merge.merge_guard(arr("Alpha_x Beta_y"), arr("alpha_x"))) == "low_anchor_coverage" and one(spark, merge.merge_guard(arr("甲"), arr("乙"))) is None
    assert one(spark, merge.fresh_items(arr("A "), arr("a", "b", "c"), 1)) == ["b"]


def test_timeline_numbers_and_sources(spark):
    shape = "reality_id long, event_no long, session_id string, topic_id long, turns array<long>, overview string, changes array<string>, strand_id long"
    ev = spark.createDataFrame([(1, 1, "s1", 1, [1], "o1", ["c"], 5), (1, 2, "s2", 1, [2], "o2", [], 6), (1, 3, "s1", 2, [3], "o3", None, 5)], shape)
    tl = merge.timelines(ev).first().timeline
    assert [(x.seq, x.entry.overview, x.entry.changes) for x in tl] == [(1, "o1", None), (2, None, ["c"]), (3, "o2", None), (4, "o3", None)]
    assert merge.source_maps(ev).first().source_strands == {"s1": [5], "s2": [6]}


def test_recall_paths(spark):
    r = spark.createDataFrame([(1, "alpha work", "h", [1.0, 0.0], {"own": [1]}), (2, "beta work", "h", [0.8, 0.6], None), (3, "gamma", "h", [0.0, 1.0], None), (4, "delta", "h", None, None)], "reality_id long, name string, hdl string, query_centroid array<double>, source_strands map<string,array<long>>")
    q = spark.createDataFrame([(1, "alpha", [1.0, 0.0]), (2, "gamma", [-1.0, 0.0])], "q long, text string, qv array<double>")
    links = spark.createDataFrame([(1, "reality_2", "reality_3", "depends_on"), (2, "reality_1", "reality_4", "other")], "pos long, source string, target string, relation string")
    got = recall.recall(q, r, links).orderBy("q", "rank").collect()
    assert [(x.q, x.reality_id) for x in got] == [(1, 1), (1, 2), (1, 3)]
    assert [x.reality_id for x in recall.not_own_session(r, "own").orderBy("reality_id").collect()] == [2, 3, 4]
    d = spark.createDataFrame([(1, 3)], "q long, reality_id long")
    assert [x.reality_id for x in recall.recall(q, r, links, d).collect()] == [3]
    plain = recall.recall(q.withColumn("qv", F.lit(None).cast("array<double>")).where("q = 2"), r, links).orderBy("rank").collect()
    assert plain[0].reality_id == 3


def test_health_factors(spark):
    day, seen = 86_400.0, set()
    for n, fs in ((0, 0.3), (1, 0.7), (2, 0.9), (3, 1.0)):
        for age, fa in ((1, 1.0), (31, 0.8), (91, 0.6)):
            for vec, fv in ((True, 1.0), (False, 0.5)):
                for content, fc in ((True, 1.0), (False, 0.3)):
                    seen.add((n, age, vec, content, round(fs * fa * fv * fc, 3)))
    rows = spark.createDataFrame(sorted(seen), "n int, age int, vec boolean, content boolean, want double")
    got = rows.select("want", refine.health(F.col("n"), F.lit(1000 * day) - F.col("age") * day, F.lit(1000 * day), F.col("vec"), F.col("content")).alias("got"))
    assert got.where("abs(want - got) > 1e-9").count() == 0 and len(seen) == 48


def test_dead_sources(spark):
    r = spark.createDataFrame([(1, {"x": [1], "y": [2]}), (2, None)], "reality_id long, source_strands map<string,array<long>>")
    got = refine.drop_dead_sources(r, spark.createDataFrame([("x",)], "session_id string"))
    assert {x.reality_id: x.source_strands for x in got.collect()} == {1: {"x": [1]}, 2: {}}


def test_knowledge_cleanup(spark):
    nodes = spark.createDataFrame([("reality_1", "knowledge"), ("reality_9", "knowledge"), ("reality_8", "code"), ("theme_1", "knowledge"), ("topic_s_S1", "knowledge"), ("ov_doc_x.md", "knowledge")], "id string, file_type string")
    links = spark.createDataFrame([("topic_s_S1", "reality_1"), ("reality_9", "reality_1"), ("reality_1", "ov_doc_x.md")], "source string, target string")
    kept, left = graph.clean_knowledge(nodes, links, spark.createDataFrame([(1,)], "reality_id long"), spark.createDataFrame([("topic_s_S1",)], "id string"), spark.createDataFrame([("ov_doc_y.md",)], "id string"))
    assert {r.id for r in kept.collect()} == {"reality_1", "reality_8", "topic_s_S1"} and [tuple(r) for r in left.collect()] == [("topic_s_S1", "reality_1")]


def test_reference_edges(spark):
    hits = spark.createDataFrame(
        [(1, 0, "x://a/doc.md/part.md", 0.57, "linked words here", "words here too"), (1, 1, "x://a/doc.md/.overview.md", 0.9, "", "t"), (1, 2, "x://b/other.md", 0.7, "", "t"), (2, 0, "x://INDEX.md", 0.9, "", "t"), (3, 0, "x://b/other.md", 0.57, "nothing", "alike")],
        "reality_id long, rank int, uri string, score double, title string, text string",
    )
    known = spark.createDataFrame([("ov_doc_doc.md",), ("ov_doc_other.md",), ("ov_doc_index.md",)], "id string")
    got = {(r.source, r.target) for r in graph.reference_edges(hits, known, 0.55).collect()}
    assert got == {("reality_1", "ov_doc_doc.md"), ("reality_1", "ov_doc_other.md")}
    assert graph.reference_edges(hits, known, None).count() == 0


def test_greedy_folds(spark):
    arr = lambda *x: F.array(*map(F.lit, x))
    assert one(spark, T.greedy_distinct(arr("abc", "cba", " ", "xyz"))) == ["abc", "xyz"]
    assert one(spark, T.greedy_batches(arr(5, 5, 5, 20, 1), 10)) == [0, 0, 1, 2, 3]


def test_truncation_matches_plain_python(spark):
    rng = random.Random(3)
    rows = ["".join(rng.choice("ab ，。.;、x") for _ in range(rng.randint(0, 60))) for _ in range(200)]
    got = spark.createDataFrame([(r,) for r in rows], "t string").select("t", T.safe_truncate(F.col("t"), 20).alias("a"), T.headline(F.col("t"), 10).alias("h")).collect()
    for r in got:
        assert r.a == J.truncate(r.t, 20), r.t
        assert r.h == J.short_headline(r.t, 10), r.t


def test_model_output_readers():
    assert J.semantic_text('{"core_change":"数据库设计","_assemble_status":0}') == "数据库设计"
    assert J.semantic_text('{"affairs":[{"hdl":"h","ooda":{"后续行动":["x"]}}],"changes":[{"ooda":"决策与方案","core_change":"c"}]}') == "h x c"
    assert J.repaired('{"a": [1, {"b": "tex') == {"a": [1, {"b": "tex"}]} and J.repaired('```json\n{"a": 1}\n```') == {"a": 1}
    assert J.item_number("SS7") == 7 and J.item_number("x") is None
    assert J.parse_picks('x {"selected":[{"index":2},{"index":"0"},{"index":2},{"index":9}]}', 3) == [2, 0] and J.parse_picks("?", 3) is None
    assert J.parse_assignments('{"assignments":{"strand_1":{"action":"merge","target":0},"strand_2":{"action":"merge"}}}') == {"strand_1": {"action": "merge", "target": 0}, "strand_2": {"action": "new"}}
    assert J.parse_root_decisions('[{"root_uri":"a","action":"keep"},{"action":"keep"},3]') == ([{"root_uri": "a", "action": "keep", "reason": ""}], 2)
    assert J.parse_strand_map('{"strand_to_reality":{"S1":"R4","S2":"NEW1"},"discarded_strand_ids":["S9"]}') == {"s2r": {1: 4, 2: "NEW1"}, "discarded": [9]}
    fct, head = J.parse_markup("### 决策与方案\n- 用 A\n- 无\n<stage_tag>【已实施】</stage_tag><core_change>扩容连接池。其他</core_change>")
    assert fct["consensus"] == ["用 A"] and fct["core_change"] == "扩容连接池。其他" and head == "扩容连接池。"
    clean = J.clean_increment({"changes": [{"stage_tag": "计划", "core_change": "x"}], "todo": ["x", "y", "无"]})
    assert clean["changes"] == [{"stage_tag": "计划", "core_change": "x", "ooda": "后续行动"}, {"stage_tag": "待分类", "core_change": "y", "ooda": "后续行动"}]
    assert J.build_affairs(J.parse_affairs('{"affairs":[{"ooda":{"决策与方案":["do it"]}}]}')["affairs"])["affairs"][0]["hdl"] == "do it"
    for bad in (None, "", "{", "[]", "3"):
        assert J.turn_entry(1, "h", bad) is None and not J.is_valid(bad)


def test_block_summary_without_a_model():
    a = J.turn_entry(1, "", '{"affairs":[{"hdl":"pool","ooda":{"现象与问题":["slow"],"后续行动":["watch"]}}]}')
    b = J.turn_entry(2, "later", '{"affairs":[{"hdl":"pool","ooda":{"决策与方案":["grow"]}},{"hdl":"empty","ooda":{}}]}')
    s = J.block_summary([a, b])
    assert [(x["hdl"], x["turns"]) for x in s["strands"]] == [("pool", [1, 2])] and s["status"] == "active" and s["hdl"] == "pool → later"
    assert not J.is_hollow(s) and J.is_hollow({"title": "无"}) and J.inject_size(s) > 10
    legacy = J.block_summary([J.turn_entry(3, "x" * 40, '{"changes":[{"core_change":"core","ooda":"决策与方案"}]}')])
    assert legacy["strands"][0]["ooda"] == {"决策与方案": ["core"]}


def test_carryover_shrinks_the_last_section_first():
    r = {"reality_id": 1, "name": "N", "hdl": "anchor", "current_status": {"goals": ["g" * 150] * 5, "context": ["c" * 150] * 3}, "timeline": [{"overview": "o" * 300}]}
    full, small = J.carryover_reality(r, 5000), J.carryover_reality(r, 900)
    assert "[相关资源]" in full and len(small) <= 900 and "[状态锚点]" in small and "[演进摘要]" not in small
    assert J.carryover_reality(r, 3) == "## N" and J.carryover([]) == ""


def test_tool_summaries(spark):
    s = tools.summarise("terminal", '{"command":"pytest"}', "=== \n12 passed, 1 failed in 3.21s")
    assert s["hdl"] == "pytest (12 passed, 1 failed) — 3.21s" and s["fct"]["tool_args"] == {}
    assert tools.summarise("write_file", '{"path":"/root/a.py","content":"x"}', '{"bytes_written":3}')["fct"]["result_summary"] == "已写入: ~/a.py (3 字节)"
    assert tools.summarise("patch", '{"path":"a"}', '{"success":false}')["fct"]["result_summary"] == "patch failed: a"
    assert tools.summarise("search_files", '{"pattern":"p"}', '{"total_count":5,"files":["a/x","a/y","b/z"]}')["fct"]["result_summary"] == "search_files: 5 matches [a:2, b:1]"
    assert tools.summarise("todo", "{}", '{"summary":{"total":2,"pending":1},"todos":[{"content":"do","status":"pending"}]}')["hdl"] == "todo: 2 项（1 pending） — do"
    assert tools.summarise("odd", "{}", '{"error":"no"}')["hdl"] == "odd: 失败" and tools.summarise(None, None)["hdl"].startswith("unknown_tool")
    assert tools.summarise("skill_view", '{"name":"s"}', '{"body":"# t\\n## Usage\\ndo\\n## Other\\nx","description":"d"}')["fct"]["result_summary"].count("## ") >= 2
    assert tools.thought_summary("开始。 先看代码。然后改。") == "先看代码。 然后改。"
    rows = spark.createDataFrame([("s", 1, 1, "tool", "odd", "{}", '{"result":"fine"}', None)], "session_id string, turn long, seq long, role string, tool_name string, args_json string, elm string, fct string")
    assert summary.backfill_tools(rows).first().hdl == "odd: fine"


def test_blocks_through_spark(spark):
    t = spark.createDataFrame([("s", 1, 0, "user", None, "q", None, None), ("s", 1, 1, "assistant", "stop", "a", '{"affairs":[{"hdl":"pool","ooda":{"决策与方案":["grow"]}}]}', "h"), ("s", 2, 1, "assistant", "stop", "a", "{bad", "h")], "session_id string, turn long, seq long, role string, finish_reason string, elm string, fct string, hdl string")
    seg = spark.createDataFrame([("s", 1, 1), ("s", 2, 1)], "session_id string, turn long, topic_id int")
    lines = summary.strands_of(summary.summarise_blocks(summary.turn_entries(t), seg)).collect()
    assert [(x.hdl, x.turns, x.status) for x in lines] == [("pool", [1], "completed")]
    out = spark.createDataFrame([("s", 1, 1, '{"affairs":[{"hdl":"A","ooda":{"决策与方案":["b"]}}]}')], "session_id string, turn long, seq long, output string")
    fr = spark.createDataFrame([("s", 1, 1, "q"), ("s", 2, 1, "asked")], "session_id string, turn long, seq long, question string")
    assert sorted((r.turn, r.hdl) for r in summary.summaries_from_model(fr, out).collect()) == [(1, "A"), (2, "asked")]


def test_think_context(spark):
    cards = spark.createDataFrame([("s", 1, 2, "decision", "p2"), ("s", 1, 1, "orient", "p1"), ("s", 1, 3, "decision", "p3"), ("s", 1, 4, "conclusion", "p4")], "session_id string, turn long, seq long, card_kind string, preview string")
    th = spark.createDataFrame([("s", 1, 1, "x" * 900)], "session_id string, turn long, seq long, elm string")
    q = spark.createDataFrame([("s", 1, "why")], "session_id string, turn long, question string")
    text = summary.think_context(cards, th, q).first().context
    assert text.index("orient|seq=1") < text.index("decision|seq=2") and "seq=3" not in text and "…[截断]" in text


def test_documents(spark):
    rows = [
        ("a.md", "[x](b.md) [gone](c.md) [w](wiki/z.md) [n](http://x) [m](../out.md)"), ("b.md", "---\ntrace:\n  forward:\n  - src/k.py\n  backward:\n  - b0.md\nsource_files: [src/l.py, all]\n---\n"), ("d/c.md", "ok"), ("INDEX.md", "| 1 | [a](architecture/01-x.md) | v |\n"),
        ("architecture/02-y/02-y.md", ""), ("changelog.md", "| 版本 | 日期 | a | b | c |\n| --- | --- | --- | --- | --- |\n| **v1** | 2024-01-01 | a | b | c |\n| **v2** | 1.1.24 | a | b |\n### v1 x\n"),
    ]
    f = spark.createDataFrame(rows, "path string, text string")
    assert {(r.target, r.category, r.suggested) for r in docs.broken_links(f).where("path = 'a.md'").collect()} == {("c.md", "relative", "d/c.md"), ("wiki/z.md", "wiki_remnant", ""), ("../out.md", "needs_human", "")}
    code = spark.createDataFrame([("lib/k.py", "# see docs/b.md and docs/none.md\n"), ("src/l.py", "")], "path string, text string")
    assert {(r.ref, r.suggested) for r in docs.broken_traces(f, code).collect()} == {("src/k.py", "lib/k.py"), ("b0.md", "")}
    assert {(r.kind, r.item) for r in docs.index_report(f).collect()} == {("missing", "architecture/02-y"), ("orphan", "architecture/01-x.md")}
    assert {(r.line, r.issue) for r in docs.changelog_report(f).collect()} == {(4, "columns"), (4, "date"), (4, "section")}
    assert [r.ref for r in docs.code_references(code, f).collect()] == ["none.md"]
    tree = spark.createDataFrame([(None, "r"), ("r", "a"), ("a", "b"), ("b", "r")], "parent string, child string")
    assert {(r.node, r.level) for r in docs.tree_rows(tree).collect()} == {("r", 0), ("a", 1), ("b", 2)}


def test_settings():
    c = load({"rrf_k": "70", "bm25_b": "x", "unknown": 1}, {"TRACEWELL_THETA_MAX": "0.4"})
    assert (c.rrf_k, c.bm25_b, c.theta_max) == (70, 0.75, 0.4)
    with pytest.raises(ValueError):
        Config(pressure_start=9, pressure_peak=9).validate()


def test_bad_json_is_null(spark):
    assert one(spark, S.json_or_null(F.lit("{bad"), "array<double>")) is None and one(spark, S.json_or_null(F.lit("null"), "array<double>")) is None
    assert one(spark, S.json_or_null(F.lit("[1.5]"), "array<double>")) == [1.5]


def test_model_responses(spark):
    from tracewell.functions import model_io as M

    use = lambda t: tuple(one(spark, M.usage_tokens(F.lit(t))))
    assert use('{"prompt_tokens":5,"output_tokens":7}') == (5, 7) and use('{"prompt_tokens":"x"}') == (None, None) and use("{") == (None, None)
    assert M.reasoning('{"reasoning":"a","provider_data":{"reasoning_content":"a","reasoning_details":[{"text":"b\\nc"}]},"content":"<think>z</think>"}') == "a\n\nb\n\nc"
    assert M.reasoning('{"content":"x <think> z </think>"}') == "z" and M.reasoning("[") == "" and M.content_text('{"content":"x"}') == "x"
    assert M.tool_calls('{"tool_calls":[{"id":"1","function":{"name":"f","arguments":"{bad"}},{"name":"g","arguments":{"a":1}}]}') == [{"id": "1", "type": "function", "function": {"name": "f", "arguments": "{}"}}, {"id": "", "type": "function", "function": {"name": "g", "arguments": '{"a": 1}'}}]


def test_prompt_texts():
    from tracewell.functions import prompts as P

    e = J.turn_entry(2, "h", '{"changes":[{"core_change":"c","stage_tag":"计划","ooda":"决策与方案"}],"consensus":["k"]}')
    assert P.turns_for_prompt([e]) == "changes:\n\n# 轮次 2\n    ## 决策与方案\n    - [计划] c\n# 轮次 2 额外信息\n    ## 共识\n    - k"
    text = P.strands_for_prompt([{"hdl": "s", "turns": [1], "ooda": {"后续行动": ["x"]}, "candidates": [{"name": "n", "hdl": "a", "current_status": {"goals": ["g"]}}]}], "现象与问题", "候选 reality")
    assert text == "# Strand 1\nhdl: s\n## 后续行动\n- x\n## 候选 reality\n  [0] n\n      hdl: a\n      goals: g"
    assert P.topic_carryover([], "s") == "" and "1. r" in P.topic_carryover([{"title": "t", "user_requests": ["r"]}], "s")
    assert "goals: 9 条" in P.size_warnings({"goals": list("abcdefghi")}, merge.SECTION_LIMITS) and P.size_warnings({}, merge.SECTION_LIMITS) == ""
    assert P.merge_wiki({"title": "a", "changes": ["x"]}, {"changes": ["x", "y"]})["changes"] == ["x", "y"]


def test_batches_and_prefilter(spark):
    s = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 1.0]), (3, [1.0, 1.0])], "strand_id long, vec array<double>")
    r = spark.createDataFrame([(7, [1.0, 0.1]), (8, [0.1, 1.0]), (9, [-1.0, -1.0]), (10, [0.0, 0.0])], "reality_id long, vec array<double>")
    assert {x.reality_id for x in merge.prefilter(s.where("strand_id < 3"), r, 1).collect()} == {7, 8}
    said = spark.createDataFrame([(1, "NEWa"), (2, "7"), (3, "NEWa")], "strand_id long, target string")
    got = merge.build_in_batches([s.where("strand_id < 3"), s.where("strand_id = 3")], 10, lambda b: said)
    assert {x.strand_id: x.reality_id for x in got.collect()} == {1: 11, 2: 7, 3: 12}
    gone = merge.uncovered(s, spark.createDataFrame([(1, 7)], S.STRAND_MAP), spark.createDataFrame([(3,)], "strand_id long"))
    assert [x.strand_id for x in gone.collect()] == [2]


def test_other_sources(spark, tmp_path):
    from tracewell.sources import extra

    (tmp_path / "g.json").write_text('{"nodes":[{"id":"reality_1","label":"L","metadata":{"uri":"u"}}],"links":[{"source":"a","target":"b","relation":"r","weight":2.0}]}')
    nodes, links = extra.read_graph(spark, f"file://{tmp_path}/g.json")
    assert nodes.first().metadata == {"uri": "u"} and links.first().weight == 2.0
    (tmp_path / "s1.db").write_bytes(b"x")
    (tmp_path / "topics.db").write_bytes(b"x")
    assert {p.path.rsplit("/", 1)[1] for p in extra.recent_sessions(spark, f"file://{tmp_path}").collect()} == {"g.json", "s1.db"}
    rows = spark.createDataFrame([("a",), ("b",)], "t string")
    known = spark.createDataFrame([("a", [9.0])], "text string, vec array<double>")
    got = {x.t: x.vec for x in extra.embed(rows, "t", known, 4).collect()}
    assert got["a"] == [9.0] and len(got["b"]) == 4 and got["b"] == extra.seeded_vector("b", 4)
    m = spark.createDataFrame([("up", "Up", {"p": 'a"b'}, 1.0)], "name string, help string, labels map<string,string>, value double")
    assert extra.metrics_text(m) == '# HELP up Up\n# TYPE up gauge\nup{p="a\\"b"} 1.0\n'


def test_streams_end_to_end(spark, tmp_path):
    from tracewell.streaming import counters, segmentation

    turns_ = spark.createDataFrame([("s", 1, "alpha beta", "alpha beta", 0), ("s", 2, "alpha again", "alpha again", 0), ("s", 3, "moving on", "zz", 0), ("t", 1, "x y z words", None, 0)], "session_id string, turn long, message string, fct string, total_tokens long")
    turns_.write.parquet(str(tmp_path / "turns"))
    stream = spark.readStream.schema(turns_.schema).parquet(str(tmp_path / "turns"))
    q = segmentation.segment_stream(stream, expire=False).writeStream.format("memory").queryName("seg").outputMode("append").option("checkpointLocation", str(tmp_path / "c1")).trigger(availableNow=True).start()
    assert q.awaitTermination(120)
    got = sorted((r.session_id, r.turn, r.topic_id, r.is_switch) for r in spark.table("seg").collect())
    assert got == sorted((r.session_id, r.turn, r.topic_id, r.is_switch) for r in topics.segment(turns_).collect())
    d = spark.sql("select 's' as session_id, 'r' as request_id, id as event_id, timestamp'2024-01-01' as ts, if(id % 2 = 0, 'text', 'reasoning') as kind, id as chars from range(6)")
    d.unionByName(d).write.parquet(str(tmp_path / "deltas"))
    counters.start_counters(spark.readStream.schema(d.schema).parquet(str(tmp_path / "deltas")), "counted", str(tmp_path / "c2")).awaitTermination()
    assert tuple(spark.table("counted").first()) == ("s", "r", 6, 9, 6)
