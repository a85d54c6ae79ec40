"""What the engine calls outside itself: a model, a fetcher. Both are plain objects that executors can unpickle."""

from __future__ import annotations

import json
import time
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from typing import Protocol


class ModelError(Exception):
    """A call that failed upstream."""


class ModelProvider(Protocol):
    """A provider may also have ``stream`` with the same arguments, which gives the answer piece by piece and is preferred then."""

    def complete(self, system: str, user: str, max_tokens: int, temperature: float) -> str:
        """The whole answer; raises ModelError if the call fails."""


class FetchError(Exception):
    """A fetch without any answer."""


class Fetcher(Protocol):
    def fetch(self, url: str, agent: str, recorded: str | None) -> tuple[int, str, str]:
        """Status, kind (html or text), body, called as ``agent``; ``recorded`` is what a replay answers. Raises FetchError if there is no answer."""


@dataclass
class HttpFetcher:
    """Plain HTTP by the standard library: redirects followed, text in the charset that the answer names."""

    timeout: float = 20.0
    most: int = 10 << 20
    #: What each agent says it is.
    agents: dict[str, str] = field(default_factory=lambda: {"service": "tessella/1.0", "browser": "Mozilla/5.0 (Macintosh; Intel Mac OS X 10_15_7) AppleWebKit/537.36 (KHTML, like Gecko) Chrome/126.0 Safari/537.36"})

    def fetch(self, url: str, agent: str, recorded: str | None = None) -> tuple[int, str, str]:
        import urllib.error
        import urllib.request

        try:
            request = urllib.request.Request(url, headers={"User-Agent": self.agents[agent]})
            with urllib.request.urlopen(request, timeout=self.timeout) as answer:
                status, head, body = answer.status, answer.headers, answer.read(self.most)
        except urllib.error.HTTPError as e:
            status, head, body = e.code, e.headers, e.read(self.most)
        except (OSError, ValueError) as e:
            raise FetchError(str(getattr(e, "reason", e))) from e
        try:
            text = body.decode(head.get_content_charset() or "utf-8", "replace")
        except LookupError:
            text = body.decode("utf-8", "replace")
        return status, "html" if head.get_content_type() in ("text/html", "application/xhtml+xml") else "text", text


@dataclass
class ScriptedFetcher:
    """Answers by link and agent; what is not in the script fails."""

    answers: dict[tuple[str, str], tuple[int, str, str]] = field(default_factory=dict)

    def fetch(self, url: str, agent: str, recorded: str | None) -> tuple[int, str, str]:
        if (url, agent) not in self.answers:
            raise FetchError(f"{agent} is down")
        return self.answers[url, agent]


@dataclass
class ReplayFetcher:
    """Answers what was recorded, and fails by the number in the link's path: no answer, other statuses, verification pages, blank pages."""

    #: Fixed value: a verification page.
    wall: str = "<html><title>验证</title><body><p>环境异常，请完成验证</p></body></html>"

    def fetch(self, url: str, agent: str, recorded: str | None) -> tuple[int, str, str]:
        import re

        found = re.search(r"/([0-9]+)", url)
        n = int(found[1]) if found else 0
        if n % 9 == 1 and (agent == "service" or n % 2 == 0):
            raise FetchError("no provider" if agent == "service" else "timeout")
        if n % 11 == 3:
            return 404, "html", recorded or ""
        if n % 7 == 2 and (agent == "service" or n % 14 == 2):
            return 200, "html", self.wall
        if n % 13 == 4:
            return 200, "text", f"plain {n}"
        if n % 17 == 5:
            return 200, "html", "<script>nothing to see</script>"
        return 200, "html", recorded or ""


def pick_model(selected: tuple[str, str] | None, catalog: dict[str, list[str]]) -> tuple[str, str]:
    """The selected provider and model if both are given, else the first model of the first provider."""
    if selected and all(selected):
        return selected
    if not catalog:
        raise ValueError("no model provider")
    provider = next(iter(catalog))
    if not catalog[provider]:
        raise ValueError(f"provider {provider} has no model")
    return provider, catalog[provider][0]


@dataclass
class FixtureProvider:
    """A deterministic double: answers by rule, and fails or cuts answers where told."""

    answer: Callable[[str, str], str] | None = None
    script: dict[str, list[str]] = field(default_factory=dict)

    def complete(self, system: str, user: str, max_tokens: int, temperature: float) -> str:
        for key, answers in self.script.items():
            if key in user:
                # the number of corrections in the prompt's budget tells which attempt this is
                step = answers[min(len(answers) - 1, user.count(CORRECTION))]
                if step.startswith("!"):
                    raise ModelError(step[1:])
                return step
        return self.answer(system, user) if self.answer else extract_stub(user)


@dataclass
class PiecewiseProvider:
    """A double that streams the answers of another provider in pieces, with a pause before each; it breaks off after ``most`` pieces if told so."""

    whole: ModelProvider
    size: int = 16
    pause: float = 0.0
    most: int | None = None

    def complete(self, system: str, user: str, max_tokens: int, temperature: float) -> str:
        return self.whole.complete(system, user, max_tokens, temperature)

    def stream(self, system: str, user: str, max_tokens: int, temperature: float) -> Iterator[str]:
        text = self.complete(system, user, max_tokens, temperature)
        for n, i in enumerate(range(0, len(text), self.size)):
            if self.most is not None and n >= self.most:
                raise ModelError("the stream broke off")
            time.sleep(self.pause)
            yield text[i : i + self.size]


#: Mark of the note that is put behind a prompt after a failed attempt.
CORRECTION = "[correction]"


def extract_stub(user: str) -> str:
    """A stand-in for a model: the first sentences as title, thesis and arguments. Not a reading of the text."""
    body = user.split("\n\n", 1)[-1]
    parts = [p.strip() for p in body.replace("\n", " ").split(". ") if p.strip()][:6] or [""]
    return json.dumps(
        {
            "title": parts[0][:40], "summary": parts[0][:80], "thesis": parts[-1][:80], "arguments": [{"claim": p[:60], "evidence": p[60:120]} for p in parts], "quotes": [{"text": parts[0][:60]}],
            "concepts": [{"term": parts[0].split(" ")[0]}], "questions": [parts[-1][:30]], "structure": [p[:20] for p in parts], "citations": [{"claim": parts[0][:20]}],
            "points": [{"claim": p[:60]} for p in parts], "explanation": body[:120], "toc": [parts[0][:20]], "coreQuestion": parts[0][:30], "coreConclusions": [parts[-1][:30]], "items": [{"type": "事实", "claim": p[:60]} for p in parts],
            "comparison": [{"theme": parts[0][:20], "positions": [{"doc": "1", "view": parts[-1][:20]}]}], "synthesis": parts[-1][:40], "reviewPlan": [{"interval": "第1天", "focus": parts[0][:10]}],
        },
        ensure_ascii=False,
    )
