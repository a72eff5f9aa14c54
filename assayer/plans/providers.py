"""Calls to language and embedding models as batch stages.

A provider is a picklable object with ``generate(prompts) -> list[str]`` or ``embed(texts) ->
list[list[float]]``. A stage takes distinct requests only, looks them up in a cache table first
(anti-join), calls the provider for the rest with retries inside the task, and writes the answers to
the journal before anyone reads them: a repeated action or a lost task's retry re-reads the journal.
"""

from __future__ import annotations

import json
import os
import queue
import re
import threading
import time
import urllib.error
import urllib.parse
import urllib.request
import uuid
from collections.abc import Callable, Iterator
from concurrent.futures import FIRST_COMPLETED, Future, ThreadPoolExecutor, wait
from dataclasses import dataclass, field
from typing import Protocol

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


class ProviderError(RuntimeError):
    pass


class NotFinished(ProviderError):
    """The model stopped before its answer was complete: not tried again."""


class LlmProvider(Protocol):
    def generate(self, prompts: list[str]) -> list[str]: ...


class EmbeddingProvider(Protocol):
    def embed(self, texts: list[str]) -> list[list[float]]: ...


@dataclass(frozen=True)
class RunConfig:
    """How often and how patiently a call is made. Milliseconds."""

    attempts: int = 10
    first_wait: int = 1_000
    most_wait: int = 60_000
    timeout: int = 180_000
    concurrency: int = 16
    batch: int = 32
    raise_errors: bool = False

    def __post_init__(self) -> None:
        for name in ("attempts", "timeout", "concurrency", "batch"):
            if getattr(self, name) < 1:
                raise ValueError(f"{name} must be positive")
        if self.first_wait > self.most_wait:
            raise ValueError("first_wait must not exceed most_wait")


def _in_time(call: Callable[[], list], milliseconds: int) -> list:
    """The call's result, or a TimeoutError after that time; a call that hangs is left behind."""
    out: queue.Queue = queue.Queue()

    def run() -> None:
        try:
            out.put((call(), None))
        except BaseException as e:
            out.put((None, e))

    threading.Thread(target=run, daemon=True).start()
    try:
        value, error = out.get(timeout=milliseconds / 1000)
    except queue.Empty:
        raise TimeoutError(f"no answer within {milliseconds} ms") from None
    if error:
        raise error
    return value


def with_retries(call: Callable[[], list], config: RunConfig, sleep: Callable[[float], None] = time.sleep) -> list:
    """Each attempt within ``timeout``, with exponential back-off up to ``most_wait`` between them; an
    unfinished answer is final."""
    wait = config.first_wait
    for left in range(config.attempts - 1, -1, -1):
        try:
            return _in_time(call, config.timeout)
        except NotFinished:
            raise
        except Exception:
            if not left:
                raise
            sleep(wait / 1000)
            wait = min(wait * 2, config.most_wait)
    raise AssertionError


@dataclass(frozen=True)
class Scripted:
    """A provider that answers by a function, for tests and rules."""

    answer: Callable[[str], str]

    def generate(self, prompts: list[str]) -> list[str]:
        return [self.answer(p) for p in prompts]


@dataclass(frozen=True)
class HashEmbedding:
    """Deterministic vectors from character trigrams, for tests."""

    size: int = 64

    def embed(self, texts: list[str]) -> list[list[float]]:
        import zlib

        out = []
        for t in texts:
            v = [0.0] * self.size
            for i in range(len(t) - 2):
                v[zlib.crc32(t[i : i + 3].lower().encode()) % self.size] += 1.0
            out.append(v)
        return out


FINISHED = {"stop", "STOP", "MAX_TOKENS", "eos_token", "end_turn"}


@dataclass(frozen=True)
class HttpProvider:
    """A chat and embedding endpoint with the usual JSON shapes."""

    base_url: str
    model: str
    api_key: str = ""
    timeout: float = 180.0
    #: Names the header that holds the bare key, where that is not the usual bearer's.
    key_header: str = ""
    query: dict[str, str] = field(default_factory=dict)

    def request(self, path: str, body: dict) -> urllib.request.Request:
        head = {"Content-Type": "application/json"}
        if self.api_key:
            head |= {self.key_header: self.api_key} if self.key_header else {"Authorization": f"Bearer {self.api_key}"}
        tail = "?" + urllib.parse.urlencode(self.query) if self.query else ""
        return urllib.request.Request(self.base_url.rstrip("/") + path + tail, json.dumps(body).encode(), head)

    def _post(self, path: str, body: dict) -> dict:
        r = self.request(path, body)
        try:
            with urllib.request.urlopen(r, timeout=self.timeout) as f:
                return json.load(f)
        except urllib.error.HTTPError as e:
            raise ProviderError(f"provider error: status {e.code}: {safe_body(e.read().decode(errors='replace'), self.api_key)}") from None

    def generate(self, prompts: list[str]) -> list[str]:
        return [parse_chat(self._post("/chat/completions", {"model": self.model, "messages": [{"role": "user", "content": p}]})) for p in prompts]

    def generate_metered(self, prompts: list[str]) -> list[tuple[str, int | None, int | None]]:
        out = []
        for p in prompts:
            reply = self._post("/chat/completions", {"model": self.model, "messages": [{"role": "user", "content": p}]})
            used = reply.get("usage") or {}
            out.append((parse_chat(reply), used.get("prompt_tokens"), used.get("completion_tokens")))
        return out

    def embed(self, texts: list[str]) -> list[list[float]]:
        return parse_embeddings(self._post("/embeddings", {"model": self.model, "input": texts}))


def parse_chat(reply: dict) -> str:
    choices = reply.get("choices") or []
    if not choices:
        raise ProviderError("provider error: no choices")
    reason = choices[0].get("finish_reason")
    if reason is not None and reason not in FINISHED:
        raise NotFinished(f"the model stopped early: {reason}")
    return (choices[0].get("message") or {}).get("content") or ""


def parse_embeddings(reply: dict) -> list[list[float]]:
    return [d["embedding"] for d in sorted(reply.get("data") or [], key=lambda d: d.get("index", 0))]


def stored(path: str) -> Callable[[DataFrame], DataFrame]:
    """Writes each table as Parquet below path, which all machines share, and reads it back."""

    def keep(df: DataFrame) -> DataFrame:
        at = f"{path.rstrip('/')}/{uuid.uuid4().hex}"
        df.write.parquet(at)
        return df.sparkSession.read.schema(df.schema).parquet(at)

    return keep


def safe_body(body: str, secret: str = "", most: int = 2048) -> str:
    """A reply's text for an error: cut, without the key and without bearer tokens."""
    body = body.replace(secret, "***") if secret else body
    body = re.sub(r"(?i)(bearer\s+)[^\s\"',}]+", r"\1***", body)
    return body if len(body) <= most else body[:most] + "..."


@dataclass(frozen=True)
class Normalized:
    """An embedding provider whose vectors are brought to length 1; zero vectors stay."""

    inner: EmbeddingProvider

    def embed(self, texts: list[str]) -> list[list[float]]:
        out = []
        for v in self.inner.embed(texts):
            n = sum(x * x for x in v) ** 0.5
            out.append([x / n for x in v] if n else v)
        return out


def in_flight(one: Callable[[list[str]], pd.DataFrame], stream: Iterator[pa.RecordBatch], config: RunConfig) -> Iterator[pd.DataFrame]:
    """``one`` of each ``config.batch`` requests, ``config.concurrency`` at a time, as they are done. Four times
    as many wait or are done at most: what a task holds beside Arrow's batch is bounded by the settings."""
    waiting: set[Future] = set()
    with ThreadPoolExecutor(config.concurrency) as pool:
        for batch in stream:
            for s in range(0, batch.num_rows, config.batch):
                waiting.add(pool.submit(one, batch.column(0).slice(s, config.batch).to_pylist()))
                if len(waiting) >= 4 * config.concurrency:
                    done, waiting = wait(waiting, return_when=FIRST_COMPLETED)
                    while done:
                        yield done.pop().result()
            del batch  # else it is held while the next one is read
            pa.default_memory_pool().release_unused()
        while waiting:
            done, waiting = wait(waiting, return_when=FIRST_COMPLETED)
            while done:
                yield done.pop().result()


def call_stage(requests: DataFrame, provider: LlmProvider | EmbeddingProvider, keep: Callable[[DataFrame], DataFrame], cache: DataFrame | None = None, config: RunConfig = RunConfig()) -> DataFrame:
    """(request, answer or vector, error) per distinct request of column ``request``, and the tokens of
    providers that meter them (``generate_metered``). ``keep`` writes a table to storage and reads it
    back; it is what makes the calls happen once. A task makes up to ``concurrency`` calls at a time;
    with ``raise_errors`` the first failure of the stage is raised."""
    embeds, meters = not hasattr(provider, "generate"), hasattr(provider, "generate_metered")
    out = "vector array<float>" if embeds else "answer string"
    name = out.split()[0]
    todo = requests.select("request").where("request is not null").distinct()
    if cache is not None:
        todo = todo.join(cache.where("error is null").select("request"), "request", "left_anti")

    def one(asked: list[str]) -> pd.DataFrame:
        call = provider.embed if embeds else provider.generate_metered if meters else provider.generate
        try:
            got, errors = with_retries(lambda: call(asked), config), [None] * len(asked)
            if len(got) != len(asked):
                raise ProviderError(f"expected {len(asked)} results, got {len(got)}")
        except Exception as e:
            got, errors = [None] * len(asked), [f"{e} (batch of {len(asked)})" if embeds else str(e)] * len(asked)
        if not meters:
            return pd.DataFrame({"request": asked, name: got, "error": errors})
        parts = [x or (None, None, None) for x in got]
        return pd.DataFrame({"request": asked, name: [x[0] for x in parts], "error": errors, "prompt_tokens": pd.array([x[1] for x in parts], "Int64"), "completion_tokens": pd.array([x[2] for x in parts], "Int64")})

    arrow = pa.schema([("request", pa.string()), ("vector", pa.list_(pa.float32())) if embeds else ("answer", pa.string()), ("error", pa.string()), *[(f"{k}_tokens", pa.int64()) for k in ("prompt", "completion") if meters]])

    def run(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for got in in_flight(one, stream, config):
            yield pa.RecordBatch.from_pandas(got, schema=arrow, preserve_index=False)

    schema = f"request string, {out}, error string" + (", prompt_tokens long, completion_tokens long" if meters else "")
    fresh = keep(todo.repartition("request").mapInArrow(run, schema))
    if config.raise_errors:
        bad = fresh.where("error is not null").orderBy("request").first()
        if bad:
            raise ProviderError(bad["error"])
    if cache is not None:
        known = cache.where("error is null").select("request", name, "error").join(requests.select("request").distinct(), "request", "left_semi")
        fresh = fresh.unionByName(known, allowMissingColumns=True)
    return fresh


def usage_rows(stage: DataFrame, provider: str, metric: str) -> DataFrame:
    """The journal rows (provider, metric_name, tokens) of a metered stage's successful calls."""
    ok = stage.where("error is null and (prompt_tokens is not null or completion_tokens is not null)")
    total = F.coalesce("prompt_tokens", F.lit(0)) + F.coalesce("completion_tokens", F.lit(0))
    return ok.select(F.lit(provider).alias("provider"), F.lit(metric).alias("metric_name"), "prompt_tokens", "completion_tokens", total.alias("total_tokens"))


class Registry:
    """Providers by name."""

    def __init__(self) -> None:
        self._of: dict[str, object] = {}

    def register(self, name: str, provider: object) -> None:
        self._of[name] = provider

    def get(self, name: str) -> object:
        if name not in self._of:
            raise ProviderError(f"no provider {name}; known: {', '.join(self.names())}")
        return self._of[name]

    def names(self) -> list[str]:
        return sorted(self._of)


@dataclass(frozen=True)
class ProviderConfig:
    """Where the models are: from the environment, else from a file of NAME=value lines, else defaults."""

    base_url: str = "http://localhost:8000/v1"
    model: str = "default"
    embedding_model: str = "default"
    api_key: str = ""
    timeout_ms: int = 180_000
    attempts: int = 10

    @classmethod
    def load(cls, environ: dict[str, str], file: str | None = None, prefix: str = "ASSAYER_") -> ProviderConfig:
        held = {}
        if file and os.path.exists(file):
            with open(file, encoding="utf-8") as f:
                for line in f:
                    k, eq, v = line.strip().partition("=")
                    if eq and not k.startswith("#"):
                        held[k.removeprefix("export ").strip()] = v.strip().strip("\"'")
        values = {}
        for name, kind in (("base_url", str), ("model", str), ("embedding_model", str), ("api_key", str), ("timeout_ms", int), ("attempts", int)):
            raw = environ.get(prefix + name.upper(), held.get(prefix + name.upper()))
            if raw:
                values[name] = kind(raw)
        return cls(**values)

    def shown(self) -> dict[str, str]:
        """For people to read: the key is masked."""
        return {k: ("***" if self.api_key else "") if k == "api_key" else str(getattr(self, k)) for k in sorted(self.__dataclass_fields__)}


def benchmark(spark: SparkSession, providers: dict[str, LlmProvider | EmbeddingProvider], prompts: list[str]) -> DataFrame:
    """(provider, prompt, seconds, units, error) for each provider and prompt, measured on the executors;
    units are the answer's bytes, or the length of its vector."""
    rows = spark.createDataFrame([(n, p) for n in sorted(providers) for p in prompts], "provider string, prompt string")

    def run(stream: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in stream:
            out = []
            for name, prompt in zip(pdf["provider"], pdf["prompt"], strict=True):
                p, began, units, error = providers[name], time.perf_counter(), 0, None
                try:
                    units = len(p.generate([prompt])[0].encode()) if hasattr(p, "generate") else len(p.embed([prompt])[0])
                except Exception as e:
                    error = str(e)
                out.append((name, prompt, time.perf_counter() - began, units, error))
            yield pd.DataFrame(out, columns=["provider", "prompt", "seconds", "units", "error"])

    return rows.mapInPandas(run, "provider string, prompt string, seconds double, units long, error string")


def json_block(answer: str) -> str:
    """The first object or array of an answer, from a fenced block if there is one."""
    fence = answer.find("```json")
    t = answer[fence + 7 :] if fence >= 0 else answer
    start = min((i for i in (t.find("{"), t.find("[")) if i >= 0), default=-1)
    if start < 0:
        return t.strip()
    opener, closer, deep = t[start], "}" if t[start] == "{" else "]", 0
    for i in range(start, len(t)):
        deep += (t[i] == opener) - (t[i] == closer)
        if deep == 0:
            return t[start : i + 1]
    return t.strip()


def rule_judge(prompt: str) -> str:
    """A judge by rules, in place of a model: statements are sentences, a verdict is shared words."""
    head, _, rest = prompt.partition(": ")
    if head == "statements of":
        return json.dumps({"statements": [s.strip() for s in rest.split(".") if s.strip()]})
    statements, _, ctx = rest.partition("\ncontext: ")
    known = set(ctx.lower().split())
    return json.dumps({"verdicts": [{"verdict": int(bool(known & set(s.lower().split())))} for s in json.loads(statements)]})
