"""A model behind an HTTP interface for chat: prompts out of PROMPTS, answers as names, Turtle or JSON verdicts."""

from __future__ import annotations

import json
import re
import urllib.request
import zlib
from collections.abc import Callable
from dataclasses import dataclass

from graphloom.plans.models import PROMPTS
from graphloom.sources import turtle

#: Where each provider is asked, unless base_url says otherwise (which only the second takes).
PROVIDERS = {"openai": "https://api.openai.com/v1", "ollama": "http://localhost:11434/v1"}
EXCERPT = 1000


def over_http(url: str, headers: dict[str, str], body: dict) -> dict:
    with urllib.request.urlopen(urllib.request.Request(url, json.dumps(body).encode(), headers | {"Content-Type": "application/json"}), timeout=600) as f:
        return json.load(f)


@dataclass
class Client:
    """A plans.models.Model. registry: the ontologies that prompts show. An answer that can't be read is a ValueError, which the workflow counts as a failed
    attempt; send is what carries a request."""

    provider: str = "openai"
    model: str = "gpt-4o-mini"
    api_key: str | None = None
    base_url: str | None = None
    temperature: float = 0.1
    registry: dict[str, list[tuple]] | None = None
    send: Callable[[str, dict[str, str], dict], dict] = over_http

    def __post_init__(self) -> None:
        if self.provider not in PROVIDERS:
            raise ValueError(f"unknown provider: {self.provider}")
        if self.provider == "openai" and not self.api_key:
            raise ValueError("this provider needs an api_key")

    def __call__(self, prompt: str) -> str:
        base = (self.base_url if self.provider == "ollama" else None) or PROVIDERS[self.provider]
        headers = {"Authorization": f"Bearer {self.api_key}"} if self.api_key else {}
        got = self.send(f"{base}/chat/completions", headers, {"model": self.model, "temperature": self.temperature, "messages": [{"role": "user", "content": prompt}]})
        try:
            return got["choices"][0]["message"]["content"]
        except (KeyError, IndexError, TypeError) as e:
            raise ValueError("the answer has no content") from e

    def extract(self, prompt: str, fields: dict[str, type]) -> dict:
        """A JSON object with these fields."""
        text = self(f"{prompt}\n\nAnswer with a JSON object of the fields {', '.join(f'{k} ({t.__name__})' for k, t in fields.items())} and nothing else.")
        m = re.search(r"\{.*\}", text, re.S)
        try:
            got = json.loads(m[0]) if m else {}
            return {k: t(got[k]) for k, t in fields.items()}
        except (KeyError, TypeError, json.JSONDecodeError) as e:
            raise ValueError(f"the answer isn't such an object: {text[:200]!r}") from e

    def turtle(self, prompt: str, prefixes: str = "") -> list[tuple]:
        text = self(prompt)
        m = re.search(r"```(?:turtle|ttl)?\s*\n(.*?)```", text, re.S)
        return [t[:5] for t in turtle.parse(prefixes + (m[1] if m else text), tag=f"m{zlib.crc32(text.encode()):x}")]

    def _shown(self, name: str) -> str:
        return turtle.render([(*t, None, None) for t in (self.registry or {}).get(name, [])])

    def select(self, ontologies: list[str], text: str) -> str:
        return self(PROMPTS["select"].format(ontologies="\n".join(ontologies), excerpt=text[:EXCERPT])).strip()

    def ontology(self, name: str, text: str, note: str | None) -> list[tuple]:
        return self.turtle(PROMPTS["ontology"].format(name=name, ontology=self._shown(name), text=text, note=f"{note}\n\n" if note else ""))

    def criticise_ontology(self, text: str, addendum: list[tuple], visit: int) -> tuple[bool, float, str]:
        return self._verdict("criticise_ontology", text=text, addendum=turtle.render([(*t, None, None) for t in addendum]))

    def facts(self, namespace: str, text: str, note: str | None) -> list[tuple]:
        return self.turtle(PROMPTS["facts"].format(ontology="", text=text, namespace=namespace, note=f"{note}\n\n" if note else ""), f"@prefix cd: <{namespace}> .\n")

    def criticise_facts(self, text: str, facts: list[tuple], visit: int) -> tuple[bool, float, str]:
        return self._verdict("criticise_facts", text=text, facts=turtle.render([(*t, None, None) for t in facts]))

    def _verdict(self, prompt: str, **what: str) -> tuple[bool, float, str]:
        got = self.extract(PROMPTS[prompt].format(**what), {"success": bool, "score": float, "critique": str})
        return got["success"], got["score"], got["critique"]

    def summary(self, name: str) -> dict:
        """What the model makes of an ontology: title and description."""
        return self.extract(PROMPTS["summary"].format(ontology=self._shown(name)), {"title": str, "description": str})
