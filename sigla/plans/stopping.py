"""Stopping a step while it runs: after its batch, at once, or when its time is up.

A step works in batches, each of which is in the checkpoint before the next begins.  The first
interrupt (SIGINT) lets the batch that runs come to its end, as its answers are paid for; the second
does what it did before, which for a Spark session is to cancel all jobs of the application, and
leaves what is out to the next run.
"""

from __future__ import annotations

import signal
import threading
import time
from collections.abc import Callable, Iterator
from contextlib import contextmanager


class Interrupted(Exception):
    """A step was stopped before its end: what it had decided is in its checkpoint."""


class Stopping:
    """A context in which interrupts, or the clock (``until``, as of ``time.time``), end a step.

    Signals can be handled in the main thread only; elsewhere ``interrupt`` does what they do.
    """

    def __init__(self, until: float | None = None, clock: Callable[[], float] = time.time):
        self._until, self._clock = until, clock
        self._before, self.interrupts = None, 0

    def __enter__(self) -> Stopping:
        if threading.current_thread() is threading.main_thread():
            self._before = signal.signal(signal.SIGINT, self.interrupt)
        return self

    def __exit__(self, *_) -> None:
        if self._before is not None:
            signal.signal(signal.SIGINT, self._before)

    def interrupt(self, *signalled) -> None:
        self.interrupts += 1
        if self.interrupts >= 2:
            if callable(self._before):  # a session's own handler: it cancels the jobs that run
                self._before(*signalled)
            raise KeyboardInterrupt

    @property
    def why(self) -> str | None:
        """Why no further batch may begin; null if one may."""
        if self.interrupts:
            return "interrupted"
        return "out of time" if self._until is not None and self._clock() >= self._until else None

    @contextmanager
    def batch(self, kept: str) -> Iterator[None]:
        """A batch that can be left; ``kept`` tells where earlier ones are."""
        try:
            yield
        except (Exception, KeyboardInterrupt) as error:
            if self.interrupts < 2:
                raise
            raise Interrupted(f"interrupted at once; {kept}") from error
