"""What the log keeps of a model call's request and response, as expressions over JSON text."""

from __future__ import annotations

import json
import re
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F

from tracewell.functions.fct import load

#: Tags and fields that hold reasoning.
INLINE = ("think", "thinking", "thought", "reasoning", "REASONING_SCRATCHPAD")
CONTAINERS = ("reasoning_details", "codex_reasoning_items", "codex_message_items", "anthropic_content_blocks")
PART_KEYS = ("thinking", "text", "summary", "content")


def usage_tokens(usage: Column) -> Column:
    """``struct<prompt, completion>`` of a usage object; null where it has no whole number."""
    number = lambda key: F.expr("null").cast("long") if key is None else F.try_to_number(F.regexp_extract(F.get_json_object(usage, f"$.{key}"), r"^(\d{1,18})$", 1), F.lit("9" * 18)).cast("long")
    return F.struct(number("prompt_tokens").alias("prompt"), F.coalesce(number("completion_tokens"), number("output_tokens")).alias("completion"))


def argument_text(arguments: Any) -> str:
    """Arguments of a tool call as JSON text; what isn't valid becomes an empty object."""
    if isinstance(arguments, str):
        try:
            json.loads(arguments)
            return arguments
        except ValueError:
            return "{}"
    try:
        return "{}" if arguments is None else json.dumps(arguments, ensure_ascii=False, allow_nan=False)
    except (TypeError, ValueError):
        return "{}"


def tool_calls(message: str | None) -> list[dict]:
    """A message's tool calls with arguments as text; calls may be flat or nested in a function."""
    found = (load(message) or {}).get("tool_calls") if isinstance(load(message), dict) else None
    out = []
    for c in found if isinstance(found, list) else []:
        if isinstance(c, dict):
            f = c.get("function") if isinstance(c.get("function"), dict) else c
            out.append({"id": c.get("id") or "", "type": c.get("type") or "function", "function": {"name": f.get("name") or "", "arguments": argument_text(f.get("arguments"))}})
    return out


def reasoning(message: str | None) -> str:
    """All reasoning of a message, each part once: its own fields, then providers' containers, and
    only without those the tags inside its content. Plain content is never reasoning."""
    m = load(message)
    if not isinstance(m, dict):
        return ""
    data = m.get("provider_data") if isinstance(m.get("provider_data"), dict) else {}
    parts = [data.get("reasoning_content"), m.get("reasoning")]
    for key in CONTAINERS:
        held = data.get(key)
        for x in [held] if isinstance(held, (str, dict)) else held if isinstance(held, list) else []:
            text = x if isinstance(x, str) else next((x[k] for k in PART_KEYS if isinstance(x.get(k), str) and x[k]), "") if isinstance(x, dict) else ""
            parts += text.split("\n")
    parts = [p for p in parts if isinstance(p, str) and p]
    content = m.get("content")
    if not parts and isinstance(content, list):
        parts = [str(b.get("thinking") or b.get("text") or "") for b in content if isinstance(b, dict) and b.get("type") == "thinking"]
    elif not parts and isinstance(content, str):
        parts = [x.strip() for tag in INLINE for x in re.findall(rf"<{tag}>(.*?)</{tag}>", content, re.S | re.I)]
    return "\n\n".join(dict.fromkeys(p for p in parts if p))


def content_text(message: str | None) -> str:
    m = load(message)
    return m["content"] if isinstance(m, dict) and isinstance(m.get("content"), str) else ""
