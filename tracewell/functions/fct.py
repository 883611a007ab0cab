"""Summaries as JSON: reading model output, the two stored formats, and what is derived from them.

The functions are plain Python over one value; :func:`udf` makes Arrow-batched column functions.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable
from typing import Any

import pandas as pd
from pyspark.sql import functions as F

#: Stages of a summary, the fields that older summaries had for them, states and blanks.
STAGES = ("现象与问题", "背景与约束", "决策与方案", "后续行动")
FIELDS = {"new_materials": "现象与问题", "objective_facts": "背景与约束", "consensus": "决策与方案", "todo": "后续行动"}
STATES = frozenset({"已实施", "计划", "探讨", "已取消"})
NO_CORE = frozenset({"无", "暂无", "无有效增量", "无新增", "none", "null", "", "无变化", "无明显变化", "无核心变化", "无核心变更"})
BLANKS = frozenset({"", "无", "無", "none", "-", "- 无", "—", "— 无", "暂无", "无有效内容", "本轮无新增", "本轮无", "- 本轮无新增", "- 本轮无"})
NO_NEWS = "本轮无新内容"
META_KEYS = frozenset({"stage_tag", "ooda", "_assemble_status", "_truncated", "_fct_format"})
MEANINGLESS_HEADLINES = frozenset({"", "无", "无新内容", "无新增", "效果如何", "如何", "好", "ok", "OK", "是", "嗯", "是的", "了解", "好的", "继续"})


def udf(f: Callable[..., Any], returns: str = "string"):
    """``f`` of one or more values as a column function; structured results come as JSON text."""

    @F.pandas_udf(returns)
    def run(*columns: pd.Series) -> pd.Series:
        out = [f(*(None if x is pd.NA else x for x in row)) for row in zip(*columns, strict=True)]
        return pd.Series([json.dumps(x, ensure_ascii=False) if isinstance(x, (dict, list)) and returns == "string" else x for x in out])

    return run


def load(text: str | None) -> Any:
    """Parsed JSON, or None."""
    try:
        return json.loads(text) if text else None
    except ValueError:
        return None


def texts(value: Any) -> list[str]:
    """The non-blank items of a list as trimmed text; a single text counts as one item."""
    items = [value] if isinstance(value, str) else value if isinstance(value, (list, tuple)) else []
    return [s for s in (str(x).strip() for x in items if x is not None) if s]


def stages_of(holder: Any) -> dict[str, list[str]]:
    own = holder.get("ooda") if isinstance(holder, dict) else None
    return {s: texts((own if isinstance(own, dict) else {}).get(s)) for s in STAGES}


def semantic_text(raw: str | None) -> str:
    """What a summary says, without its keys and bookkeeping; text that isn't an object stays.

    Values come depth first, in the order written. A stage object inside an affair is content; the
    stage label of a change isn't.
    """
    top = load(raw)
    if not isinstance(top, (dict, list)):
        return raw or ""
    out: list[str] = []
    todo: list[tuple[Any, bool]] = [(top, False)]
    while todo:
        value, inside = todo.pop()
        if isinstance(value, str):
            if value.strip():
                out.append(value.strip())
        elif isinstance(value, list):
            todo.extend((x, inside) for x in reversed(value))
        elif isinstance(value, dict):
            nxt = []
            for key, x in value.items():
                if key == "affairs" and isinstance(x, list):
                    nxt.append((x, True))
                elif key == "ooda" and inside or key == "changes":
                    nxt.append((x, False))
                elif key not in META_KEYS:
                    nxt.append((x, inside))
            todo.extend(reversed(nxt))
    return " ".join(out)


# -- reading model output --------------------------------------------------------------------------


def unfenced(text: str | None) -> str:
    """The content of the first code fence, else the text itself; trimmed."""
    found = re.search(r"```(?:json)?\s*(.*?)```", text or "", re.S)
    return (found[1] if found else (text or "")).strip()


def object_in(text: str | None) -> dict | None:
    """The object from the first brace to the last, or None."""
    t = re.sub(r"```(?:json)?", "", text or "")
    found = load(t[t.find("{") : t.rfind("}") + 1]) if "{" in t and "}" in t else None
    return found if isinstance(found, dict) else None


def array_in(text: str | None) -> list | None:
    t = re.sub(r"```(?:json)?", "", text or "")
    found = load(t[t.find("[") : t.rfind("]") + 1]) if "[" in t and "]" in t else None
    return found if isinstance(found, list) else None


def repaired(text: str | None) -> Any:
    """JSON whose end is missing: an open string is closed, then what else is open, innermost first."""
    t = unfenced(text)
    if (found := load(t)) is not None:
        return found
    if t.count('"') % 2 and (found := load(t + '"')) is not None:
        return found
    open_, quoted, escaped = [], False, False
    for ch in t:
        if escaped or ch == "\\":
            escaped = not escaped
        elif ch == '"':
            quoted = not quoted
        elif not quoted and ch in "{[":
            open_.append("}" if ch == "{" else "]")
        elif not quoted and open_ and ch == open_[-1]:
            open_.pop()
    tail = '"' * quoted + "".join(reversed(open_))
    for cut in (t, re.sub(r",\s*$", "", t)):
        for closing in (tail, *("}" * n for n in range(5, 0, -1)), *("]" * n + "}" * n for n in range(5, 0, -1))):
            if (found := load(cut + closing)) is not None:
                return found
    return None


def item_number(value: Any) -> int | None:
    """7 of 'S7', 'SS7', 'R7' or 7."""
    found = re.fullmatch(r"\D*(\d+)", str(value).strip())
    return int(found[1]) if found else None


def parse_affairs(text: str | None) -> dict | None:
    """``{"affairs": [...]}`` of model output, each with headline, turns and stages; None if there is none."""
    raw = (object_in(unfenced(text)) or {}).get("affairs")
    affairs = []
    for a in raw if isinstance(raw, list) else []:
        if isinstance(a, dict):
            turns = a.get("turns") if isinstance(a.get("turns"), list) else []
            one = {"hdl": str(a.get("hdl") or "").strip(), "turns": [int(t) for t in turns if isinstance(t, int) or str(t).isdigit()], "ooda": stages_of(a)}
            if old := valid_changes(a.get("changes")):
                one["changes"] = old
            affairs.append(one)
    return {"affairs": affairs} if affairs else None


def valid_changes(changes: Any) -> list[dict[str, str]]:
    """Changes of a known state that say something."""
    pairs = ((str(c.get("stage_tag") or "").strip(), str(c.get("core_change") or "").strip()) for c in changes or [] if isinstance(c, dict))
    return [{"stage_tag": s, "core_change": core} for s, core in pairs if s in STATES and core not in NO_CORE]


def affair_headline(affair: dict, number: int) -> str:
    if affair.get("hdl"):
        return affair["hdl"][:30]
    first = [c["core_change"] for c in affair.get("changes", [])[:1]]
    for s in ("现象与问题", "决策与方案", "后续行动", "背景与约束"):
        first += (affair.get("ooda") or {}).get(s, [])[:1]
    return first[0][:30] if first else f"事务{number}"


def build_affairs(affairs: list[dict], status: Any = 0) -> dict:
    """The stored summary of affairs, every one with a headline."""
    return {"affairs": [a | {"hdl": affair_headline(a, k)} for k, a in enumerate(affairs, 1)], "_assemble_status": status, "_fct_format": "v3"}


#: The format of a stage and its change in that older output.
MARKUP_PAIR = r"<stage_tag>\s*【([^】]+)】\s*</stage_tag>\s*<core_change>\s*(.*?)\s*</core_change>"


def parse_markup(text: str | None) -> tuple[dict, str | None]:
    """The older output format: headings with items, and pairs of state and change tags. Returns the
    summary and its headline."""
    body = truncate(text or "", 2000)
    pairs = re.findall(MARKUP_PAIR, body, re.S | re.I)
    changes = valid_changes([{"stage_tag": s, "core_change": c} for s, c in pairs])
    out: dict[str, Any] = {"changes": changes, "core_change": "；".join(c["core_change"] for c in changes) or NO_NEWS} | {f: [] for f in FIELDS}
    titles, field = {s: f for f, s in FIELDS.items()}, None
    for line in map(str.strip, body.split("\n")):
        if head := re.match(r"###\s+(.+)$", line):
            field = titles.get(head[1].strip().rstrip("：:"))
        elif field and (item := re.match(r"[-*•]\s+(.+)$", line)) and item[1].strip() not in ("无", "無", "none") and len(out[field]) < 3:
            out[field].append(item[1].strip()[:50])
    if not changes:
        return out, None
    first = re.match(r"(?s)[^。！？.!?\n]*[。！？.!?\n]?", changes[0]["core_change"])[0].rstrip("\r\n")
    headline = truncate(first or changes[0]["core_change"], 100)
    return out, None if headline in NO_CORE else headline


def clean_increment(data: dict) -> dict:
    """An older summary without blanks, its narrative fields turned into changes where it has changes."""
    if data.get("_truncated"):
        return {"changes": [], "core_change": NO_NEWS}
    changes, core = valid_changes(data.get("changes")), str(data.get("core_change") or "").strip()
    if not changes and core not in NO_CORE and core != NO_NEWS:
        state = str(data.get("stage_tag") or "").strip()
        changes = [{"stage_tag": state if state in STATES else "已实施", "core_change": core}]
    said = "；".join(c["core_change"] for c in changes) or NO_NEWS
    fields = {f: [t for t in (data.get(f) if isinstance(data.get(f), list) else []) if t and t.strip() not in BLANKS][:3] for f in FIELDS}
    fields = {f: v for f, v in fields.items() if v}
    if changes:
        known = {c["core_change"]: c for c in changes}
        for f, items in fields.items():
            for t in map(str.strip, items):
                if t in known:
                    known[t]["ooda"] = FIELDS[f]
                else:
                    changes.append(known.setdefault(t, {"stage_tag": "待分类", "core_change": t, "ooda": FIELDS[f]}))
        return {"changes": changes, "core_change": said}
    draft = (fields.get("consensus") or fields.get("new_materials") or [None])[0]
    if draft:
        changes, said = [{"stage_tag": "已实施", "core_change": draft}], draft
    return fields | {"changes": changes, "core_change": said}


def truncate(text: str, n: int) -> str:
    """At most ``n`` characters: to the last sentence end, else the last clause end, else cut hard."""
    if len(text) <= n:
        return text
    cut = text[:n]
    for marks in ("。！？.!?", "，；;,:："):
        at = max(cut.rfind(m) for m in marks)
        if at >= 0 and cut[: at + 1].strip():
            return cut[: at + 1].strip()
    return re.sub(r"[,，;；:：.\s]+$", "", cut.strip())


def to_markdown(data: dict | None) -> str:
    """An older summary in the format that prompts ask for."""
    data = data or {}
    parts = []
    for f, title in FIELDS.items():
        items = data.get(f) if isinstance(data.get(f), list) else []
        if items:
            parts.append("\n".join([f"### {title}", *(f"- {str(x)[:50]}" for x in items[:3])]))
    core = str(data.get("core_change") or "").strip()
    pairs = [f"<stage_tag>\n【{c['stage_tag']}】\n</stage_tag>\n<core_change>\n{c['core_change']}\n</core_change>" for c in valid_changes(data.get("changes"))]
    if not data.get("changes") and core not in NO_CORE and core != NO_NEWS:
        pairs = [f"<core_change>\n{core}\n</core_change>"]
    return "\n\n".join(parts + pairs)


def previous_for_prompt(raw: str | None) -> str:
    """The summary of the turn before, as a prompt shows it."""
    text = (raw or "").strip()
    if text in ("", "无", "null"):
        return "【无历史回顾】——本轮所有内容相对空历史均为首次出现，必须全部提取为新增内容"
    data = load(text)
    if not isinstance(data, dict):
        return text
    lines = []
    for k, a in enumerate(data.get("affairs") if isinstance(data.get("affairs"), list) else [], 1):
        body = [f"- {s}：{x}" for s, items in stages_of(a).items() for x in items]
        if body:
            lines += [f"## 事务{k}：{str(a.get('hdl') or f'事务{k}').strip()}", *body]
    return "\n".join(lines) or to_markdown(data) or text


# -- derived from stored summaries ------------------------------------------------------------------


def turn_entry(turn: int, headline: str | None, raw: str | None) -> dict | None:
    """What later steps read of a turn's summary, from either stored format; None for bad JSON."""
    data = load(raw)
    if not isinstance(data, dict):
        return None
    out: dict[str, Any] = {"turn": turn, "hdl": headline or "", "changes": [], "tags": {}, "ooda_tags": {}, "todos": [], "user_requests": [], "consensus": [], "key_facts_supp": [], "new_materials": [], "affairs": []}
    add = lambda to, x: x and x not in out[to] and out[to].append(x)

    def take_changes(changes: Any, repeat: bool) -> None:
        for c in changes if isinstance(changes, list) else []:
            core = str(c.get("core_change") or c.get("change") or "").strip() if isinstance(c, dict) else ""
            if not core:
                continue
            out["changes"].append(core) if repeat else add("changes", core)
            if tag := str(c.get("stage_tag") or "").strip():
                out["tags"][core] = tag
                if tag == "评估中":
                    add("todos", core)
            if isinstance(c.get("ooda"), str) and c["ooda"].strip():
                out["ooda_tags"][core] = c["ooda"].strip()
            add("user_requests", str(c.get("user_request") or "").strip())

    affairs = data.get("affairs")
    if isinstance(affairs, list) and affairs:
        views = {"现象与问题": "new_materials", "背景与约束": "key_facts_supp", "决策与方案": "consensus", "后续行动": "todos"}
        for a in affairs:
            if isinstance(a, dict):
                stages = stages_of(a)
                out["affairs"].append({"hdl": str(a.get("hdl") or "").strip(), "turns": a["turns"] if isinstance(a.get("turns"), list) else [turn], "ooda": stages})
                for s, items in stages.items():
                    for x in items:
                        add("changes", x)
                        out["ooda_tags"][x] = s
                        add(views[s], x)
                take_changes(a.get("changes"), False)
        out["hdl"] = out["hdl"] or next((a["hdl"] for a in out["affairs"] if a["hdl"]), "")
        return out
    take_changes(data.get("changes") or data.get("changes_before"), True)
    for to, field in (("consensus", "consensus"), ("key_facts_supp", "objective_facts"), ("new_materials", "new_materials")):
        out[to] = texts(data.get(field))
    return out


def is_valid(raw: str | None) -> bool:
    """Whether a stored summary says anything."""
    data = load(raw)
    if not isinstance(data, dict):
        return False
    affairs = data.get("affairs") if isinstance(data.get("affairs"), list) else []
    return any(any(stages_of(a).values()) for a in affairs) or bool(data.get("changes")) or str(data.get("core_change") or "") not in ("", NO_NEWS)


def headline_of(data: dict) -> str:
    """The headline of a summary: its first affair's, else its changes, else its first item, else 无."""
    affairs = [a for a in data.get("affairs") or [] if isinstance(a, dict)]
    named = [str(a.get("hdl") or "").strip() for a in affairs]
    named += [x for a in affairs for s in ("决策与方案", "现象与问题", "后续行动", "背景与约束") for x in stages_of(a)[s][:1]]
    if found := next((x for x in named if x), ""):
        return truncate(found, 100) or "无"
    core = "；".join(str(c.get("core_change") or "") for c in data.get("changes") or [] if isinstance(c, dict))
    if not core:
        core = re.split("【计划】|【探讨】", str(data.get("core_change") or ""))[0].rstrip() or str(data.get("core_change") or "")
    if core in ("", "无", NO_NEWS):
        core = next((x for f in ("consensus", "new_materials") for x in texts(data.get(f))[:1] if x not in BLANKS and x != "- 无新增"), "")
    return truncate(core, 100) or "无"


def meaningful_headline(text: str | None) -> bool:
    t = (text or "").strip()
    return len(t) >= 8 and t not in MEANINGLESS_HEADLINES


#: Field names that models copy into their values.
COPIED_PREFIXES = ("重写后的当前状态锚点：", "重写后的当前状态锚点:", "当前状态锚点：", "当前状态锚点:")


def without_prefix(text: str | None) -> str:
    t = (text or "").strip()
    return next((t[len(p) :].strip() for p in COPIED_PREFIXES if t.startswith(p)), t)


def parse_reality(text: str | None) -> dict | None:
    """A work object of model output, with copied field names taken off."""
    data = repaired(text)
    if not isinstance(data, dict):
        return None
    out = {k: without_prefix(v) if k in ("name", "hdl") and isinstance(v, str) else v for k, v in data.items()}
    if isinstance(out.get("current_status"), dict):
        out["current_status"] = {k: [without_prefix(x) if isinstance(x, str) else x for x in v] if isinstance(v, list) else v for k, v in out["current_status"].items()}
    return out


def parse_picks(text: str | None, candidates: int) -> list[int] | None:
    """The places that a model picked, in its order, each once; None if its answer can't be read."""
    picked = (object_in(text) or {}).get("selected")
    if not isinstance(picked, list):
        return None
    places = [item_number(x.get("index")) for x in picked if isinstance(x, dict) and x.get("index") is not None]
    return [p for p in dict.fromkeys(places) if p is not None and p < candidates]


def parse_assignments(text: str | None) -> dict[str, dict]:
    """Action and target of each work-line; a merge without a usable target is new."""
    out = {}
    raw = (object_in(text) or {}).get("assignments")
    for key, v in (raw if isinstance(raw, dict) else {}).items():
        if isinstance(v, dict):
            t = v.get("target")
            merge = str(v.get("action", "")).lower() == "merge" and isinstance(t, int) and not isinstance(t, bool) and t >= 0
            out[str(key)] = {"action": "merge", "target": t} if merge else {"action": "new"}
    return out


def parse_root_decisions(text: str | None) -> tuple[list[dict], int]:
    """Valid decisions on document roots, and how many weren't."""
    rows = array_in(text)
    if rows is None:
        return [], int(bool(text))
    ok = [r for r in rows if isinstance(r, dict) and isinstance(r.get("root_uri"), str) and r["root_uri"].strip() and r.get("action") in ("keep", "enable", "disable", "remove")]
    return [{"root_uri": r["root_uri"].strip(), "action": r["action"], "reason": r["reason"] if isinstance(r.get("reason"), str) else ""} for r in ok], len(rows) - len(ok)


def parse_relation(text: str | None) -> str:
    found = (object_in(text) or {}).get("relation")
    return found if found in ("depends_on", "continues") else "none"


def parse_strand_map(text: str | None) -> dict | None:
    """Which object each work-line goes to (a number, or a name that begins with NEW), and the discarded."""
    data = object_in(text) or {}
    where = data.get("strand_to_reality")
    out = {}
    for k, v in (where if isinstance(where, dict) else {}).items():
        to = str(v).strip() if str(v).strip().upper().startswith("NEW") else item_number(v)
        if item_number(k) is not None and to is not None:
            out[item_number(k)] = to
    gone = [n for n in map(item_number, data.get("discarded_strand_ids") or []) if n is not None]
    return {"s2r": out, "discarded": gone} if out else None


# -- block summaries --------------------------------------------------------------------------------


def ordered(*lists: list[str]) -> list[str]:
    return list(dict.fromkeys(x for items in lists for x in items if x))


def block_headline(entries: list[dict]) -> str:
    """The first turn's headline to the last's, its first sentence, at most 30 characters."""
    ends = ordered([e.get("hdl", "").strip() for e in (entries[:1] + entries[-1:])])
    text = " → ".join(ends)
    for mark in ("。", ". ", "；", "; "):
        if mark in text:
            text = text.split(mark)[0] + ("。" if mark in "。；" else "")
            break
    return short_headline(text)


def short_headline(text: str | None, n: int = 30) -> str:
    t = (text or "").strip()
    if len(t) <= n:
        return t
    places = (t.find(m) for m in ("。", "；", ". ", "; ", "，", "、", ", "))
    return next((t[:at].rstrip() for at in places if 0 < at <= n), t[:n])


def _turns(entries: list[dict]) -> list[int]:
    """The turns of entries that have one; 0 is a turn like any other."""
    return [e["turn"] for e in entries if e.get("turn") is not None]


def affair_strands(entries: list[dict], fallback: str = "") -> list[dict]:
    """Work-lines of a block without a model: affairs of one headline over all turns; empty ones go."""
    found: dict[str, tuple[dict, dict]] = {}  # turns and stages' items, in the order of their keys
    for e in entries:
        for a in e.get("affairs") or []:
            name = (a.get("hdl") or e.get("hdl") or fallback or f"事务{len(found) + 1}").strip()
            turns, ooda = found.setdefault(name, ({}, {s: {} for s in STAGES}))
            turns.update(dict.fromkeys(_turns([e])))
            for s, items in stages_of(a).items():
                if items:
                    ooda[s].update(dict.fromkeys(items))
    return [{"hdl": name, "turns": [*turns], "ooda": {s: [*items] for s, items in ooda.items()}} for name, (turns, ooda) in found.items() if any(ooda.values())]


def block_summary(entries: list[dict]) -> dict:
    """A block's summary without a model: work-lines, changes, facts, requests, open items, status."""
    headline = block_headline(entries)
    changes = ordered(*(e.get("changes", []) for e in entries))
    strands = affair_strands(entries, headline)
    if not strands and entries:
        tags = {c: e["ooda_tags"][c] for e in entries for c in e.get("changes", []) if c in e.get("ooda_tags", {})}
        groups = {s: [c for c in changes if tags.get(c) == s] for s in STAGES} | {"其他": [c for c in changes if tags.get(c) not in STAGES]}
        name = headline if len(headline) <= 30 else short_headline(changes[0] if changes else headline)
        strands = [{"hdl": name, "turns": _turns(entries), "ooda": {k: v for k, v in groups.items() if v}}]
    requests = ordered(*(e.get("user_requests", []) for e in entries)) or ordered(*([e.get("hdl", "").strip(), *e.get("changes", [])] for e in entries))
    active = any(t == "评估中" for e in entries for t in e.get("tags", {}).values()) or any(stages_of(a)["后续行动"] for e in entries for a in e.get("affairs") or [])
    merged = {s: [x for st in strands for x in st["ooda"].get(s, [])] for s in (*STAGES, "其他")}
    return {
        "hdl": headline, "title": headline, "changes": changes, "key_facts": [f"话题：{h}" for h in ordered([e.get("hdl", "").strip() for e in entries])], "strands": strands,
        "ooda_groups": {k: v for k, v in merged.items() if v}, "user_requests": requests[:3], "open_items": ordered(*([t.strip() for t in e.get("todos", [])] for e in entries)),
        "status": "active" if active else "completed", "consumable": True,
    }


def is_hollow(summary: dict) -> bool:
    """Whether a block has nothing to keep: such blocks become a work-line of status skip."""
    title = str(summary.get("title") or "").strip()
    said = summary.get("ooda_groups") or summary.get("changes") or summary.get("key_facts")
    return not summary.get("consumable", True) or title in ("", "无", "无新增", "无新内容") or not said


def inject_size(summary: dict) -> int:
    """Characters that a summary takes when it is shown."""
    lines = [f"## {summary.get('title') or summary.get('hdl') or 'Topic'}"]
    lines += [f"- {c}" for c in (summary.get("changes") or [])[:8]]
    lines += [f"{i}. {r}" for i, r in enumerate((summary.get("user_requests") or [])[:3], 1)]
    lines += [f"- {x}" for key in ("key_facts", "open_items") for x in (summary.get(key) or [])[:5]]
    return len("\n".join(lines)) + 2


# -- carryover --------------------------------------------------------------------------------------

#: How many items of a section stay, and how long, one step of shrinking after another.
COUNTS, LENGTHS = (None, 5, 3, 1), (200, 120, 80)


def within_budget(title: str, sections: list[tuple[str, list[str]]], budget: int) -> str:
    """A title and its sections (most important first) in at most ``budget`` characters.

    The last section shrinks first: fewer items, then shorter ones, then it goes; then the one
    before it. The title always stays.
    """
    steps = [(n, LENGTHS[0]) for n in COUNTS] + [(COUNTS[-1], n) for n in LENGTHS[1:]] + [None]
    state = [0] * len(sections)
    while True:
        shown = [f"## {title}"]
        for (name, items), k in zip(sections, state, strict=True):
            if steps[k] is not None:
                count, length = steps[k]
                shown.append("\n".join([f"[{name}]", *(f"- {x[:length]}" for x in items[:count])]))
        text = "\n\n".join(shown)
        last = next((i for i in range(len(sections) - 1, -1, -1) if steps[state[i]] is not None), None)
        if len(text) <= budget or last is None:
            return text
        state[last] += 1


def carryover_reality(r: dict, budget: int = 2000) -> str:
    name = (r.get("name") or r.get("hdl") or "").strip() or "Reality"
    status = r.get("current_status") or {}
    sections = [("状态锚点", [(r.get("hdl") or "").strip()])] if (r.get("hdl") or "").strip() not in ("", name) else []
    for label, key, n in (("进行中目标", "goals", 5), ("当前状态", "current_state", 5), ("持久事实", "key_facts", 4), ("相关资源", "context", 3)):
        if status.get(key):
            sections.append((label, texts(list(status[key]))[:n]))
    past = [str(e.get("overview") or "") for e in list(r.get("timeline") or [])[-2:] if isinstance(e, dict)]
    if any(p.strip() for p in past):
        sections.append(("演进摘要", [p for p in past if p.strip()]))
    return within_budget(name, sections, budget)


def carryover_theme(t: dict, budget: int = 2000) -> str:
    sections = [("当前状态", [t["overview"].strip()])] if (t.get("overview") or "").strip() else []
    stages = stages_of(t)
    sections += [(s, stages[s]) for s in ("后续行动", "决策与方案", "现象与问题", "背景与约束") if stages[s]]
    sections += [(label, texts(t.get(key))) for label, key in (("结论", "key_facts"), ("待办", "open_items")) if texts(t.get(key))]
    return within_budget((t.get("title") or "").strip() or "Topic", sections, budget) if sections else ""


def carryover(items: list[dict], budget: int = 2000) -> str:
    blocks = [b for b in (carryover_reality(x, budget) if "reality_id" in x else carryover_theme(x, budget) for x in items) if b]
    return "<wiki_carryover>\n" + "\n\n".join(blocks) + "\n</wiki_carryover>" if blocks else ""
