"""What a player does with one station: queues a batch without repeats, plays down to its low water, asks for the next.

The source (:mod:`tessitura.sources.radio_source`) follows it to know the cursor of each next request, the player
(:mod:`tessitura.streaming.player`) to commit what came of the answers. Both end a stretch of requests at the same row.
"""

from __future__ import annotations

from collections import deque
from dataclasses import dataclass


@dataclass(frozen=True)
class Rules:
    """``low_water`` and ``memory`` of the player; ``again``: how often a station that an error has halted asks again for one cursor without being told to; ``most``: a stretch ends with the answer that brings it to so many rows, so at 1 it is one request."""

    low_water: int = 2
    memory: int = 100
    again: int = 0
    most: int = 1


class Station:
    """The queue (seq, batch, track, played) of a station and its control row (previous, attempt, halted)."""

    def __init__(self, rules: Rules, queue: list[dict], control: dict) -> None:
        self.rules, rows = rules, sorted(queue, key=lambda r: r["seq"])
        self.played, self.waiting = (deque((r["seq"], r["batch"], r["track"]) for r in rows if r["played"] is p) for p in (True, False))
        self.known, self.top = {r["track"] for r in rows}, max((r["seq"] for r in rows), default=0)
        self.previous, self.attempt, self.halted = control["previous"], control["attempt"], control["halted"]
        self.accepted: list[tuple[int, str, str]] = []

    def hear(self, answer: list[dict]) -> bool:
        """Take the answer to a request, rows (batch, pos, track, available, error); whether the station asks on."""
        if any(r["error"] is not None for r in answer):
            self.attempt += 1
            self.halted = self.attempt > self.rules.again
            return not self.halted
        for r in sorted((r for r in answer if r["available"] and r["track"] is not None), key=lambda r: (r["pos"], r["track"])):
            if r["track"] not in self.known:
                self.known.add(r["track"])
                self.top += 1
                self.accepted.append((self.top, r["batch"], r["track"]))
                self.waiting.append(self.accepted[-1])
        if answer and self.waiting:
            for _ in range(max(len(self.waiting) - self.rules.low_water, 1)):
                self.played.append(self.waiting.popleft())
        while len(self.played) > max(self.rules.memory, 1):
            self.known.discard(self.played.popleft()[2])
        last = self.played[-1][2] if self.played else None
        if last == self.previous:
            return False
        self.previous, self.attempt = last, 0
        return True
