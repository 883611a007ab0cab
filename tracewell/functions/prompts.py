"""Texts that show turns, work-lines and candidates to a model, and summaries to a reader."""

from __future__ import annotations

from tracewell.functions.fct import STAGES, stages_of, texts


def _listed(title: str, items: list[str], indent: str = "") -> list[str]:
    return [f"{indent}{title}", *(f"{indent}- {x}" for x in items)] if items else []


def turns_for_prompt(entries: list[dict]) -> str:
    """Turns with their affairs, or with changes by stage and what supplements them."""
    out = ["changes:"]
    for e in entries:
        out += ["", f"# 轮次 {e.get('turn', 0)}"]
        affairs = e.get("affairs") or []
        if affairs:
            names = [a.get("hdl") or f"事务{i}" for i, a in enumerate(affairs, 1)]
            out += ["## 事务清单（编号即候选 strand）", *(f"{i}. {n}" for i, n in enumerate(names, 1))]
            for i, (a, n) in enumerate(zip(affairs, names, strict=True), 1):
                out.append(f"## 事务{i} {n}")
                for s, items in stages_of(a).items():
                    out += _listed(f"### {s}", items, "    ")
            continue
        groups: dict[str, list[str]] = {s: [] for s in (*STAGES, "其他")}
        for c in e.get("changes", []):
            tag, stage = e.get("tags", {}).get(c), e.get("ooda_tags", {}).get(c)
            groups[stage if stage in STAGES else "其他"].append(f"[{tag}] {c}" if tag else c)
        for s, items in groups.items():
            out += _listed(f"## {s}", items, "    ")
        more = [x for title, key in (("共识", "consensus"), ("客观事实", "key_facts_supp"), ("新增素材", "new_materials")) for x in _listed(f"## {title}", e.get(key, []), "    ")]
        out += [f"# 轮次 {e.get('turn', 0)} 额外信息", *more] if more else []
    return "\n".join(out)


def strands_for_prompt(strands: list[dict], first_stage: str | None = None, candidates: str | None = None) -> str:
    """Work-lines with headline, turns, stages and changes; with candidates, their names and goals.

    ``candidates`` is the heading of candidate lists, if there are any; ``first_stage`` comes first."""
    parts = []
    order = sorted(STAGES, key=lambda s: s != first_stage)
    for i, st in enumerate(strands, 1):
        lines = [f"# Strand {i}"] + [f"hdl: {st['hdl']}"] * bool(st.get("hdl")) + [f"turns: {list(st['turns'])}"] * bool(st.get("turns") and not candidates)
        for s in order:
            lines += _listed(f"## {s}", stages_of(st)[s])
        if not candidates:
            lines += _listed("## changes", texts(st.get("changes")))
        for k, c in enumerate(st.get("candidates") or []) if candidates else ():
            lines += [f"## {candidates}"] * (k == 0)
            name, head = c.get("name") or c.get("title") or "", c.get("hdl") or ""
            near = f" (S={c['s_score']:.2f})" if c.get("s_score") is not None and "title" in c else ""
            lines.append(f"  [{k}] {name or head or '(未命名)'}{near}" + " [注入主题]" * bool(c.get("_priority") and "title" in c))
            goals = texts((c.get("current_status") or {}).get("goals")) or stages_of(c)["后续行动"]
            for label, text in (("hdl", head if head != name else ""), ("overview", c.get("overview")), ("goals", "; ".join(goals)), ("成员", "; ".join(texts(c.get("member_hdls"))))):
                if text:
                    lines.append(f"      {label}: {text}")
        parts.append("\n".join(lines))
    return "\n\n".join(parts)


def candidates_for_pick(question: str, rows: list[dict]) -> str:
    """A question and the work objects that may go with it, numbered."""
    parts = []
    for i, r in enumerate(rows):
        status = r.get("current_status") or {}
        lines = [f"[{i}] {str(r.get('name') or '')[:60]}"] + [f"    hdl: {r['hdl'][:80]}"] * bool(r.get("hdl"))
        lines += [f"    {label}: {' | '.join(x[:60] for x in texts(status.get(key))[:3])}" for label, key in (("goals", "goals"), ("state", "current_state")) if texts(status.get(key))]
        parts.append("\n".join(lines))
    return question[:500] + "\n\n" + "\n\n".join(parts)


def topic_carryover(summaries: list[dict], session: str) -> str:
    """Recalled block summaries as one text."""
    blocks = []
    for s in summaries:
        lines = [f"## {(s.get('title') or s.get('hdl') or 'Topic')[:120]}", ""]
        for title, key, n in (("变更", "changes", 8), ("用户需求", "user_requests", 3), ("分析结论", "key_facts", 5), ("待办", "open_items", 5)):
            items = (s.get(key) or [])[:n]
            lines += [f"--- {title} ---"] * bool(items)
            lines += [f"{i}. {x[:200]}" if key == "user_requests" else f"- {x[:200]}" for i, x in enumerate(items, 1)]
        blocks.append("\n".join(lines))
    return f"<topic_carryover from='{session}'>\n" + "\n\n".join(blocks) + "\n</topic_carryover>" if blocks else ""


def size_warnings(status: dict | None, limits: dict[str, int]) -> str:
    """What a model is told about sections that hold too much; empty if none does."""
    over = {k: len(texts((status or {}).get(k))) for k in sorted(limits) if len(texts((status or {}).get(k))) > limits[k]}
    return "\n".join(["<force_consolidation>", *(f"- {k}: {n} 条 → 必须 ≤{limits[k]} 条。" for k, n in over.items()), "</force_consolidation>"]) if over else ""


def merge_wiki(old: dict, new: dict) -> dict:
    """Two summaries of one entry without a model: lists joined, the newer title if it has one."""
    from tracewell.functions.fct import ordered

    lists = {k: ordered(texts(old.get(k)), texts(new.get(k))) for k in ("changes", "key_facts", "open_items", "user_requests")}
    return old | lists | {"title": new.get("title") or old.get("title") or ""}
