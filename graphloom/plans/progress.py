"""Progress of long runs on a console."""

from __future__ import annotations

import sys
import time
from typing import TextIO


def duration(seconds: float) -> str:
    """HH:MM:SS, or MM:SS below an hour; negative ones are 0."""
    minutes, s = divmod(max(0, int(seconds)), 60)
    h, m = divmod(minutes, 60)
    return f"{h:02d}:{m:02d}:{s:02d}" if h else f"{m:02d}:{s:02d}"


class Progress:
    """Lines such as "crawl 3/9 33.33% | OK=60 | elapsed 00:04 | eta 00:08"."""

    def __init__(self, name: str, out: TextIO | None = None, clock=time.monotonic) -> None:
        self.name, self.out, self.clock = name, out or sys.stderr, clock
        self.start = clock()

    def report(self, done: float, total: float, note: str = "") -> None:
        elapsed = self.clock() - self.start
        eta = duration(elapsed / done * (total - done)) if done else "--:--"
        share = 100 * done / total if total else 100.0
        parts = [f"{self.name} {done}/{total} {share:.2f}%", *[note] * bool(note), f"elapsed {duration(elapsed)}", f"eta {eta}"]
        print(" | ".join(parts), file=self.out, flush=True)
