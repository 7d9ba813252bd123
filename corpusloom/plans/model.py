"""The model stage: prompts in, responses out, as one mapInPandas with a pluggable client.

A call that fails becomes a row with its error, never a failed task.  Clients are picklable, built once per partition, and
pure for tests: the stand-in answers from the text it is given.
"""

from __future__ import annotations

import json
import re
import time
import urllib.request
from collections.abc import Iterator
from dataclasses import dataclass, field
from datetime import UTC, datetime, timedelta
from typing import Protocol

import pandas as pd
from pyspark.sql import DataFrame

from corpusloom.operators.chunking import BODY
from corpusloom.plans.prompts import CONTENT


class ModelClient(Protocol):
    def complete(self, system: str, user: str) -> str: ...


def shown(user: str) -> str:
    """The text in a message: what follows the line before it, and in a chunk the chunk alone."""
    return user.split(CONTENT, 1)[-1].split(BODY, 1)[-1]


@dataclass(frozen=True)
class ExtractiveStub:
    """Answers with a labelled summary taken from the text it is given."""

    fail_if: str = ""

    def complete(self, system: str, user: str) -> str:
        if self.fail_if and self.fail_if in user:
            raise TimeoutError("the model call timed out")
        text = shown(user)
        lines = [x.strip() for x in text.split("\n") if x.strip()]
        bullets = [x for x in lines if len(x) > 30][:5]
        snippets = [x for x in lines if 40 <= len(x) <= 400][:3]
        out = [f"TITLE: {lines[0][:60] if lines else 'Untitled'}", f"ABSTRACT: {lines[0] if lines else ''}", "KEY POINTS:", *[f"- {b}" for b in bullets], "OPEN QUESTIONS:", "- None", "SOURCE SNIPPETS:"]
        for s in snippets:
            out += [f"TEXT: {s}", "REASON: taken from the text"]
        return "\n".join([*out, "CONFIDENCE: medium"])


@dataclass(frozen=True)
class TaggingStub:
    """Answers with tagged lines: each longer line as a claim or fact with itself as its snippet."""

    def complete(self, system: str, user: str) -> str:
        text = shown(user)
        lines = [re.sub(r"[|]", " ", x.strip()) for x in text.split("\n") if len(x.strip()) > 30]
        return "\n".join(f"{'CLAIM' if i % 2 else 'FACT'} | {x[:200]} | {x[:200]}" for i, x in enumerate(lines[:10]))


@dataclass(frozen=True)
class HttpClient:
    """A chat server: POST <url>/api/chat, not streamed."""

    url: str
    model: str
    timeout_s: float = 600.0
    options: dict = field(default_factory=lambda: {"num_predict": 384, "num_batch": 128})

    def complete(self, system: str, user: str) -> str:
        body = {"model": self.model, "messages": [{"role": "system", "content": system}, {"role": "user", "content": user}], "stream": False, "keep_alive": "5m", "options": self.options}
        request = urllib.request.Request(self.url.rstrip("/") + "/api/chat", json.dumps(body).encode(), {"Content-Type": "application/json"})
        with urllib.request.urlopen(request, timeout=self.timeout_s) as answer:
            return json.load(answer)["message"]["content"]


def call(prompts: DataFrame, client: ModelClient, attempts: int = 2, prompt: str = "prompt") -> DataFrame:
    """prompts' other columns with response, error, attempts, when the last attempt began and ended (started_at, ended_at) and
    its duration_ms; prompt is a struct<system, user>.  Repartition prompts beforehand to set how many calls run at once; key
    calls by their content if they must not be repeated."""
    keep = [f for f in prompts.schema.fields if f.name != prompt]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in keep)
    schema += (", " if keep else "") + "response string, error string, attempts int, started_at timestamp, ended_at timestamp, duration_ms bigint"

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in parts:
            made = []
            for asked in rows[prompt]:
                response = error = None
                at = datetime.now(UTC)
                for n in range(1, max(1, attempts) + 1):
                    at, began = datetime.now(UTC), time.monotonic()
                    try:
                        response, error = client.complete(asked["system"], asked["user"]), None
                        break
                    except Exception as e:  # noqa: BLE001  (any failure is a row)
                        error = f"{type(e).__name__}: {e}"
                took = round((time.monotonic() - began) * 1000)
                made.append((response, error, n, at, at + timedelta(milliseconds=took), took))
            out = rows.drop(columns=[prompt]).reset_index(drop=True)
            yield pd.concat([out, pd.DataFrame(made, columns=["response", "error", "attempts", "started_at", "ended_at", "duration_ms"])], axis=1)

    return prompts.mapInPandas(run, schema)
