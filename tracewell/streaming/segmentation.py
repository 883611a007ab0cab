"""Topic segmentation of a stream: the state of a session's open topic is kept between batches."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tracewell.config import Config
from tracewell.functions.text import FORCED_PHRASES

_CJK = re.compile("[\u4e00-\u9fff\u3400-\u4dbf\uff00-\uffef]")
_WORD = re.compile("[a-zA-Z_][a-zA-Z0-9_]*|[0-9]+")

OUT = "session_id string, turn long, topic_id int, is_switch boolean"
STATE = "state string"


def features(text: str) -> tuple[set[str], str | None, str | None]:
    """Features of a text, and its first and last CJK characters."""
    cjk = _CJK.findall(text)
    own = set(cjk) | {a + b for a, b in zip(cjk, cjk[1:], strict=False)} | set(_WORD.findall(text.lower()))
    return own, cjk[0] if cjk else None, cjk[-1] if cjk else None


@dataclass
class Session:
    """What segmentation knows of a session. It holds features, never texts."""

    last_turn: int = 0
    current: int | None = None
    next: int = 1
    any: bool = False
    profile: set[str] = field(default_factory=set)
    last: str | None = None

    def dump(self) -> str:
        return json.dumps([self.last_turn, self.current, self.next, self.any, sorted(self.profile), self.last])

    @classmethod
    def load(cls, text: str) -> Session:
        turn, current, nxt, known, profile, last = json.loads(text)
        return cls(turn, current, nxt, known, set(profile), last)

    def _open(self, topic: int, own: tuple[set[str], str | None, str | None]) -> int:
        self.current, self.any, self.next = topic, True, max(self.next, topic + 1, 2 if topic == 1 else 0)
        self.profile, self.last = set(own[0]), own[2]
        return topic

    def take(self, turn: int, message: str | None, fct: str | None = None, tokens: int = 0, config: Config = Config()) -> tuple[int | None, bool] | None:
        """Topic of a turn and whether it switches; None for a turn that was taken already, so a
        replayed row changes nothing."""
        if turn <= self.last_turn:
            return None
        before, self.last_turn = self.current, turn
        if turn <= 0 or not message:
            self.current = None
            return None, False
        nothing = (set(), None, None)
        if any(p in message.lower() for p in FORCED_PHRASES):
            topic = self._open(self.next, features(fct) if fct else nothing)
        elif self.current is not None and len(message.strip(" ")) <= config.confirm_chars:
            topic = self.current
        elif not self.any:
            topic = self._open(1, features(fct) if fct else nothing)
        else:
            own = features(fct or message)
            both = self.profile | own[0]
            span = config.pressure_peak - config.pressure_start
            pressure = config.pressure_max * min(max(tokens - config.pressure_start, 0) / span, 1.0)
            likeness = (len(self.profile & own[0]) / len(both) if both else 0.0) - pressure
            if self.current is not None and likeness >= config.jaccard_entry:
                topic = self.current
                self.profile = both | ({self.last + own[1]} if self.last and own[1] else set())
                self.last = own[2] or self.last
            else:
                topic = self._open(self.next, own)
        return topic, before is not None and topic != before


def segment_stream(turns: DataFrame, config: Config = Config(), expire: bool = True) -> DataFrame:
    """Topics of a stream of turns: ``session_id, turn, topic_id, is_switch``.

    ``turns`` is a streaming frame with ``session_id, turn, message, fct, total_tokens``. Rows of a batch are
    taken in order of turn; late or repeated turns are ignored. With ``expire``, a session that is silent
    for the time to live is forgotten; leave it off for a run over what is there (such a run has no
    clock to wait for). After a failure the query goes on from its checkpoint.
    """

    def run(key: tuple[Any, ...], frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        session = Session.load(state.get[0]) if state.exists else Session()
        rows = pd.concat(list(frames)).sort_values("turn", kind="stable")
        out = []
        for turn, message, fct, tokens in zip(rows["turn"], rows["message"], rows["fct"], rows["total_tokens"], strict=True):
            if (got := session.take(int(turn), message, fct or None, int(tokens or 0), config)) is not None:
                out.append((key[0], int(turn), got[0], got[1]))
        state.update((session.dump(),))
        if expire:
            state.setTimeoutDuration(config.session_ttl_s * 1000)
        yield pd.DataFrame({"session_id": [o[0] for o in out], "turn": [o[1] for o in out], "topic_id": pd.array([o[2] for o in out], dtype="Int32"), "is_switch": [o[3] for o in out]})

    return turns.groupBy("session_id").applyInPandasWithState(run, OUT, STATE, "append", GroupStateTimeout.ProcessingTimeTimeout if expire else GroupStateTimeout.NoTimeout)


def backfill_users(turns: DataFrame, sink, checkpoint: str):
    """Write late user rows of each batch of requests: ``sink(rows)`` gets those that the log lacks."""
    from tracewell.operators.log import missing_user_rows

    def batch(requests: DataFrame, _: int) -> None:
        sink(missing_user_rows(turns, requests))

    return lambda stream: stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
