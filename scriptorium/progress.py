"""Progress on a stream (SK14): one line a phase, redrawn in place on a terminal, at most five times a second."""

from __future__ import annotations

import sys
import time
from contextlib import contextmanager
from dataclasses import dataclass, field
from typing import IO


@dataclass
class Progress:
    enabled: bool = True
    stream: IO[str] | None = None
    every: float = 0.2
    clock: object = time.monotonic
    _open: bool = field(default=False, repr=False)

    def tell(self, line: str, *, last: bool = True) -> None:
        if not self.enabled:
            return
        out = self.stream or sys.stderr
        if getattr(out, "isatty", lambda: False)():
            out.write(("\r\x1b[2K" if self._open else "") + line + ("\n" if last else ""))
            self._open = not last
        else:
            out.write(line + "\n")
        out.flush()

    @contextmanager
    def phase(self, name: str, total: int = 0):
        """Yields a function that counts steps; the end of the phase is told with its time and rate."""
        began = shown = self.clock()
        done = 0
        of = f"/{total}" if total else ""

        def step(n: int = 1) -> None:
            nonlocal done, shown
            done += n
            now = self.clock()
            if now - shown >= self.every:
                shown = now
                rate = done / max(now - began, 1e-9)
                left = f", {(total - done) / rate:.0f} s left" if total and rate else ""
                self.tell(f"{name}: {done}{of} ({rate:.1f}/s{left})", last=False)

        self.tell(f"{name} ...")
        yield step
        took = self.clock() - began
        self.tell(f"{name}: {done}{of} in {took:.1f} s" if done else f"{name}: {took:.1f} s")
