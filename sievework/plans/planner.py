"""Where plans come from: language models over HTTP, or rules over a profile."""

from __future__ import annotations

import json
import os
import time
import urllib.error
import urllib.request
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame

from ..operators.profile import profile
from ..operators.rows import ROW
from .plan import CleaningPlan, Step


@dataclass(frozen=True)
class Settings:
    """Provider settings from the environment, with defaults."""

    provider: str = "local"
    model: str = "llama3"
    host: str = "http://localhost:11434"
    cloud_url: str = ""
    key: str = ""

    @classmethod
    def from_environment(cls, env_file: str = ".env") -> "Settings":
        """From the environment; what it lacks, from the file of name=value lines if there is one."""
        named = (read_env_file(env_file) if os.path.isfile(env_file) else {}) | os.environ
        return cls(**{f: named[f"SIEVEWORK_{f.upper()}"] for f in ("provider", "model", "host", "cloud_url", "key") if f"SIEVEWORK_{f.upper()}" in named})


def read_env_file(path: str) -> dict[str, str]:
    """name=value lines of a file; blank lines and those that begin with # are left out."""
    out = {}
    with open(path, encoding="utf-8") as f:
        for line in f:
            name, cut, value = line.strip().partition("=")
            if cut and not name.startswith("#"):
                out[name.strip()] = value.strip().strip("'\"")
    return out


def _post(url: str, body: dict, timeout: float, headers: dict[str, str] | None = None) -> dict:
    request = urllib.request.Request(url, json.dumps(body).encode(), {"Content-Type": "application/json"} | (headers or {}))
    with urllib.request.urlopen(request, timeout=timeout) as answer:
        return json.loads(answer.read())


def ask_local(prompt: str, settings: Settings, temperature: float = 0.2, post: Callable = _post) -> str:
    """A local server's text completion; 600 s at most."""
    body = {"model": settings.model, "prompt": prompt, "stream": False, "options": {"temperature": temperature}}
    return post(f"{settings.host}/api/generate", body, 600)["response"]


def ask_cloud(prompt: str, settings: Settings, temperature: float = 0.2, post: Callable = _post, tries: int = 5, wait: Callable = time.sleep) -> str:
    """A chat completion; 120 s at most. Too many requests and lost connections are tried again after 1, 2, 4, ... s."""
    if not settings.key:
        raise ValueError("no key for the cloud provider")
    body = {"model": settings.model, "messages": [{"role": "user", "content": prompt}], "temperature": temperature}
    for k in range(tries):
        try:
            return post(settings.cloud_url, body, 120, {"Authorization": f"Bearer {settings.key}"})["choices"][0]["message"]["content"]
        except urllib.error.HTTPError as e:
            if e.code != 429:
                raise
        except (urllib.error.URLError, ConnectionError):
            pass
        if k < tries - 1:
            wait(2**k)
    raise RuntimeError(f"no answer after {tries} tries")


PROVIDERS: dict[str, Callable] = {"local": ask_local, "cloud": ask_cloud}


def ask(prompt: str, settings: Settings | None = None, temperature: float = 0.2) -> str:
    settings = settings or Settings.from_environment()
    if settings.provider not in PROVIDERS:
        raise ValueError(f"unknown provider {settings.provider!r}")
    return PROVIDERS[settings.provider](prompt, settings, temperature)


def extract_code(text: str) -> str:
    """The first fenced Python block, else the first fenced block, else all of the text; stripped."""
    for mark in ("```python", "```"):
        _, _, rest = text.partition(mark)
        block, closed, _ = rest.partition("```")
        if closed:
            return block.strip()
    return text.strip()


def generate(prompt: str, settings: Settings | None = None, temperature: float = 0.2) -> str:
    """A provider's answer, reduced to its code."""
    return extract_code(ask(prompt, settings, temperature))


class Planner:
    """Gives a first plan, as text, and revisions of it."""

    def plan(self, prompt: str) -> str:
        raise NotImplementedError

    def revise(self, plan: str, prompt: str) -> str:
        return self.plan(prompt)


class ModelPlanner(Planner):
    def __init__(self, settings: Settings | None = None):
        self.settings = settings

    def plan(self, prompt: str) -> str:
        text = generate(prompt, self.settings)
        return text[text.index("[") :] if text.startswith("json") and "[" in text else text


class RulePlanner(Planner):
    """Plans from a table's profile: what is missing is imputed, text stripped, numbers bounded by their spread."""

    def __init__(self, df: DataFrame, row: str = ROW):
        self.df, self.row = df, row

    def plan(self, prompt: str = "") -> str:
        numeric, text = [], []
        for r in profile(self.df, columns=[c for c in self.df.columns if c != self.row]).collect():
            (numeric if r["dtype_detected"] == "numeric" else text).append(r)
        strings = {c for c, kind in self.df.dtypes if kind == "string"}
        names = [r["column"] for r in text if r["column"] in strings]
        steps = [Step("normalise_text", {"columns": names}), Step("disguised_to_null", {"columns": names})] if names else []
        holes = [r["column"] for r in text if r["column"] in strings and r["pct_missing"]]
        if holes:
            steps.append(Step("fill_mode", {"columns": holes}))
        bounds = {r["column"]: [r["mean"] - 4 * r["std"], r["mean"] + 4 * r["std"]] for r in numeric if r["std"] and r["column"] in self.df.columns and dict(self.df.dtypes)[r["column"]] != "boolean"}
        if bounds:
            steps.append(Step("clip", {"bounds": bounds}))
        steps.append(Step("drop_duplicate_rows", {"ignore": [self.row]} if self.row in self.df.columns else {}))
        return CleaningPlan(steps).to_json()
