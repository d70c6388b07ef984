"""Checking of answers that come in chunks: sentences are told as they end, with state variables and a timer."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql.streaming.stateful_processor import ExpiredTimerInfo, StatefulProcessor, StatefulProcessorHandle, TimerValues

from .processors import millis

# The end of a sentence, the label at its end, and forms that it must not hold.
STOP = re.compile(r"[.!?](?:\s+\[[^\[\]]+\])*\s+(?=[^\s\[])")
LABEL = re.compile(r"\[([^\[\]]+)\]$")
FORBIDDEN = re.compile(r"\((?:see\s*)?\[[^\]]+\]\)", re.IGNORECASE)


def check_sentence(sentence: str, allowed: list[str]) -> tuple[bool, str | None]:
    """Whether a sentence ends with an allowed label, and else the sentence with one, as the column functions do."""
    found = LABEL.search(sentence)
    if found and found[1].strip() in allowed and not FORBIDDEN.search(sentence):
        return True, None
    if not allowed:
        return False, None
    labels = re.findall(r"\[([^\]]+)\]", sentence)
    label = labels[-1].strip() if labels and labels[-1].strip() in allowed else min(allowed)
    return False, f"{re.sub(r'\s*\[[^\]]+\]\s*', '', sentence).strip()} [{label}]"


class Sentences(StatefulProcessor):
    """Chunks of a request in order of their numbers, cut into sentences.

    State: what is read but not told yet (`read`), the allowed labels, and the chunks that came before those they follow.
    The timer is set anew by each trigger that has chunks of the request; when it fires, what is left comes out.
    """

    columns = ["req", "seq", "sentence", "valid", "filler"]

    def __init__(self, repair: bool, run: int, ttl_ms: int) -> None:
        self.repair, self.run, self.ttl_ms = repair, run, ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.read = handle.getValueState("read", "buffer string, next int, seq int, bad int, done boolean")
        self.allowed = handle.getListState("allowed", "label string")
        self.ahead = handle.getMapState("ahead", "i int", "data string, is_end boolean")

    def _told(self, req: object, parts: list[str], seq: int, bad: int) -> tuple[list[tuple], int, int]:
        """Rows for the sentences, and the counts after them."""
        allowed, out = [label for (label,) in self.allowed.get()], []
        for sentence in filter(None, (p.strip() for p in parts)):
            valid, fixed = check_sentence(sentence, allowed)
            passed = valid or (self.repair and fixed is not None)
            bad = 0 if passed else bad + 1
            out.append((req, seq, fixed if self.repair and not valid else sentence, valid, not passed and bad % self.run == 0))
            seq += 1
        return out, seq, bad

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: TimerValues) -> Iterator[pd.DataFrame]:
        frame = pd.concat(list(rows)).sort_values("i")
        buffer, at, seq, bad, done = self.read.get() if self.read.exists() else ("", 0, 0, 0, False)
        given = [labels for labels in frame["allowed"] if labels is not None and len(labels)]
        if given:
            self.allowed.put([(label,) for label in given[-1]])
        came = {int(i): (data or "", bool(end)) for i, data, end in zip(frame["i"], frame["data"], frame["is_end"].eq(True)) if i >= at}
        while not done and (at in came or self.ahead.containsKey((at,))):
            if at in came:
                data, done = came.pop(at)
            else:
                data, done = self.ahead.getValue((at,))
            if self.ahead.containsKey((at,)):
                self.ahead.removeKey((at,))
            buffer, at = buffer + data, at + 1
        for i, chunk in came.items():
            if not done:
                self.ahead.updateValue((i,), chunk)
        ends = [0, *(m.end() for m in STOP.finditer(buffer))]
        parts, rest = [buffer[a:b] for a, b in zip(ends, ends[1:])], buffer[ends[-1] :]
        out, seq, bad = self._told(key[0], [*parts, rest] if done else parts, seq, bad)
        # a request that has ended is remembered until the timer, so that its repeated chunks change nothing
        self.read.update(("" if done else rest, at, seq, bad, done))
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        self.handle.registerTimer(max(millis(frame["ts"].max()), timerValues.getCurrentWatermarkInMs()) + self.ttl_ms)
        yield pd.DataFrame(out, columns=self.columns)

    def handleExpiredTimer(self, key: tuple, timerValues: TimerValues, expiredTimerInfo: ExpiredTimerInfo) -> Iterator[pd.DataFrame]:
        buffer, _, seq, bad, done = self.read.get()
        buffer += "".join(data for _, (data, _) in sorted(self.ahead.iterator()))
        ends = [0, *(m.end() for m in STOP.finditer(buffer)), len(buffer)]
        out = [] if done else self._told(key[0], [buffer[a:b] for a, b in zip(ends, ends[1:])], seq, bad)[0]
        for held in (self.read, self.allowed, self.ahead):
            held.clear()
        yield pd.DataFrame(out, columns=self.columns)

    def close(self) -> None:
        pass
