"""Asking a language model: its thinking settings, one request, and what to do when it fails.

Nothing here knows a provider.  ``send`` takes the fields of a chat request and returns the answer's
text; an exception of it may carry ``status_code``, as the usual clients' do.
"""

from __future__ import annotations

import queue
import threading
import time
from collections.abc import Callable
from dataclasses import dataclass, field


def _template(**variables) -> dict:
    return {"extra_body": {"chat_template_kwargs": variables}}


# Request settings by the start of a model's name, of which the longest counts, and
# by what is asked: "on", "off", or a level of thinking.  What is not listed cannot be asked.
SETTINGS: dict[str, dict[str, dict]] = {
    "apertus": {"off": {}},
    "deepseek-v4": {
        "off": _template(thinking=False),
        "low": _template(thinking=True, reasoning_effort="low"),
        "high": _template(thinking=True, reasoning_effort="high"),
        "max": _template(thinking=True, reasoning_effort="max"),
    },
    "devstral": {"off": {}},
    "gemma-4": {"on": _template(enable_thinking=True), "off": _template(enable_thinking=False)},
    "glm-4": {"on": _template(enable_thinking=True), "off": _template(enable_thinking=False)},
    "meta-llama-3.1": {"off": {}},
    "mistral-medium-3.5": {"on": {"reasoning_effort": "high"}, "off": {"reasoning_effort": "none"}, "high": {"reasoning_effort": "high"}, "none": {"reasoning_effort": "none"}},
    "openai-gpt-oss": {"low": {"reasoning_effort": "low"}, "medium": {"reasoning_effort": "medium"}, "high": {"reasoning_effort": "high"}},
    "qwen3": {"on": _template(enable_thinking=True), "off": _template(enable_thinking=False)},
    "qwen3.8": {
        "off": _template(enable_thinking=False),
        "low": {"reasoning_effort": "low"} | _template(enable_thinking=True),
        "medium": {"reasoning_effort": "medium"} | _template(enable_thinking=True),
        "xhigh": {"reasoning_effort": "xhigh"} | _template(enable_thinking=True),
    },
}
#: Levels that mean no thinking.
SILENT = {"none", "off"}


def thinking(model: str, switch: bool | None = None, level: str | None = None) -> dict:
    """Request settings that make a model think as asked; what it cannot do is refused."""
    if switch is None and level is None:
        return {}
    family = max(filter(model.startswith, SETTINGS), key=len, default=None)
    if family is None:
        raise ValueError(f"no thinking settings are known for {model}")
    asked = level or ("on" if switch else "off")
    if level is not None and switch is not None and switch == (level in SILENT):
        raise ValueError(f"level {level!r} and thinking={switch} contradict")
    if asked not in SETTINGS[family]:
        raise ValueError(f"{model} cannot be asked for {asked!r}, only for: {', '.join(SETTINGS[family])}")
    return SETTINGS[family][asked]


def known_model(model: str, available: list[str]) -> str:
    """``model`` if an endpoint lists it; a message with those that it does list otherwise."""
    if model not in available:
        raise LookupError(f"there is no model {model!r}; there is: {', '.join(sorted(available)) or 'none'}")
    return model


class ThinkingUnsupported(Exception):
    """An endpoint refused the thinking settings of a request."""


def worth_another(error: Exception) -> bool:
    """Too many calls, a failing server, or no connection: the same request may pass later."""
    status = getattr(error, "status_code", None)
    return isinstance(error, (ConnectionError, TimeoutError)) or status == 429 or (status is not None and status >= 500)


#: One thread at a time takes the next free moment of a model.
_TURN = threading.Lock()


@dataclass
class Model:
    """One model behind an endpoint: a request at temperature 0 of a system and a user message.

    Calls are ``spacing`` seconds apart, whatever the number of threads, and are tried up to
    ``again`` times more.  A call without an answer after ``patience`` seconds has failed: it is
    left where it is, so that no worker waits for it, and its answer, should one come, is not used.
    """

    send: Callable[[dict], str]
    name: str
    settings: dict = field(default_factory=dict)
    spacing: float = 4.1
    again: int = 5
    patience: float | None = None
    clock: Callable[[], float] = time.monotonic
    sleep: Callable[[float], None] = time.sleep
    free: float = 0.0
    retries: int = 0

    def request(self, system: str, user: str) -> dict:
        messages = [{"role": "system", "content": system}] * bool(system) + [{"role": "user", "content": user}]
        return {"model": self.name, "temperature": 0, "messages": messages} | self.settings

    def _sent(self, request: dict) -> str:
        if self.patience is None:
            return self.send(request)
        got: queue.SimpleQueue = queue.SimpleQueue()

        def call() -> None:
            try:
                got.put((self.send(request), None))
            except Exception as error:
                got.put((None, error))

        threading.Thread(target=call, daemon=True).start()
        try:
            answer, error = got.get(timeout=self.patience)
        except queue.Empty:
            raise TimeoutError(f"no answer within {self.patience:g} seconds") from None
        if error is not None:
            raise error
        return answer

    def ask(self, system: str, user: str) -> tuple[str, int]:
        """The answer, and how many times the call had to be repeated."""
        for tried in range(self.again + 1):
            with _TURN:
                start = max(self.clock(), self.free)
                self.free = start + self.spacing
            self.sleep(max(0.0, start - self.clock()))
            try:
                return self._sent(self.request(system, user)), tried
            except Exception as error:
                if getattr(error, "status_code", None) == 400 and self.settings:
                    raise ThinkingUnsupported(f"{self.name} does not take {self.settings}") from error
                if tried == self.again or not worth_another(error):
                    raise
                with _TURN:
                    self.retries += 1
        raise AssertionError
