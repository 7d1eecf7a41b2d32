"""Model calls behind small interfaces: configuration, HTTP connectors, and deterministic stand-ins for use without a network.

A provider is built once per worker partition, from a configuration that travels there, and called in batches; texts are made
distinct before and joined back after. Nothing calls a model from the driver.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
import time
import urllib.request
from collections.abc import Callable, Iterator, Mapping
from dataclasses import dataclass, field
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reviewloom.functions import lexicons as lx
from reviewloom.operators.flatten import decode

BATCH = 32
#: Trigrams whose hashes an encoder remembers before it forgets all, and texts whose vectors the stand-in reranker does (30 MB).
KNOWN_TRIGRAMS, KNOWN_TEXTS = 200_000, 50_000
#: Seconds that a call and a health check may take.
CALL_TIMEOUT, HEALTH_TIMEOUT = 60, 5


class Embedder(Protocol):
    def encode(self, texts: list[str]) -> np.ndarray: ...


class Reranker(Protocol):
    def score(self, pairs: list[tuple[str, str]]) -> list[float]: ...


class Completer(Protocol):
    def complete(self, prompts: list[str]) -> list[str]: ...


@dataclass(frozen=True)
class ModelConfig:
    """One model: provider, name, temperature, address, key and whether it shows its reasoning."""

    provider: str = "rules"
    model: str = ""
    temperature: float = 0.0
    base_url: str | None = None
    api_key: str | None = field(default=None, repr=False)
    reasoning: bool = False


#: Temperature of a task whose configuration names none (fixed values).
TASK_TEMPERATURE = {"insight": 0.3}


def model_config(config: dict, task: str = "default", env: Mapping[str, str] | None = None, prefix: str = "") -> ModelConfig:
    """Configuration of a task's model: `models.<task>_llm`, or the common one; variables of the environment win.

    Variables: LLM_PROVIDER, LLM_MODEL, LLM_BASE_URL and API_KEY, behind the prefix for a task of its own.
    """
    env, models = os.environ if env is None else env, config.get("models", {})
    own = models.get(f"{task}_llm")
    if own is None:
        own, prefix = {k.removeprefix("llm_"): v for k, v in models.items() if k.startswith("llm_")} | {k: models[k] for k in ("temperature", "api_key", "enable_reasoning") if k in models}, ""
    return ModelConfig(
        provider=env.get(f"{prefix}LLM_PROVIDER", own.get("provider", "ollama")),
        model=env.get(f"{prefix}LLM_MODEL", own.get("model", "qwen3:8b")),
        temperature=own.get("temperature", TASK_TEMPERATURE.get(task, 0.0)),
        base_url=env.get(f"{prefix}LLM_BASE_URL", own.get("base_url")),
        api_key=env.get(f"{prefix}API_KEY", own.get("api_key")),
        reasoning=own.get("enable_reasoning", False),
    )


def _post(url: str, body: dict | None, key: str | None = None, timeout: float = CALL_TIMEOUT) -> dict:
    headers = {"Content-Type": "application/json"} | ({"Authorization": f"Bearer {key}"} if key else {})
    request = urllib.request.Request(url, None if body is None else json.dumps(body).encode(), headers)
    with urllib.request.urlopen(request, timeout=timeout) as answer:
        return json.loads(answer.read())


#: Addresses of the providers where none is configured (fixed values).
BASE_URLS = {"ollama": "http://localhost:11434", "openai": "https://api.openai.com/v1"}


class ChatModel:
    """A chat model over HTTP that answers in JSON."""

    def __init__(self, config: ModelConfig) -> None:
        if config.provider not in BASE_URLS:
            raise ValueError(f"unsupported provider {config.provider}")
        self.config, self.url = config, (config.base_url or BASE_URLS[config.provider]).rstrip("/")

    def complete(self, prompts: list[str]) -> list[str]:
        c, answers = self.config, []
        for prompt in prompts:
            messages = [{"role": "user", "content": prompt}]
            if c.provider == "ollama":
                body = {"model": c.model, "messages": messages, "stream": False, "format": "json", "think": c.reasoning, "options": {"temperature": c.temperature}}
                answers.append(_post(f"{self.url}/api/chat", body)["message"]["content"])
            else:
                body = {"model": c.model, "messages": messages, "temperature": c.temperature, "response_format": {"type": "json_object"}}
                answers.append(_post(f"{self.url}/chat/completions", body, c.api_key)["choices"][0]["message"]["content"])
        return answers

    def healthy(self) -> bool:
        """Whether the server answers and knows the model."""
        return served(self.url, self.config.model) if self.config.provider == "ollama" else True


def served(url: str, model: str) -> bool:
    try:
        names = {m.get("name", "") for m in _post(f"{url.rstrip('/')}/api/tags", None, timeout=HEALTH_TIMEOUT).get("models", [])}
    except OSError:
        return False
    return any(n == model or n.split(":")[0] == model for n in names)


class HttpEmbedder:
    def __init__(self, model: str, base_url: str = BASE_URLS["ollama"]) -> None:
        self.model, self.url = model, base_url.rstrip("/")

    def encode(self, texts: list[str]) -> np.ndarray:
        return np.asarray([_post(f"{self.url}/api/embeddings", {"model": self.model, "prompt": t})["embedding"] for t in texts], dtype=np.float64)


class HttpReranker:
    def __init__(self, model: str, base_url: str = BASE_URLS["ollama"]) -> None:
        self.model, self.url = model, base_url.rstrip("/")

    def score(self, pairs: list[tuple[str, str]]) -> list[float]:
        answers = [_post(f"{self.url}/api/rerank", {"model": self.model, "query": a, "documents": [b]})["results"] for a, b in pairs]
        return [float(r[0]["relevance_score"]) for r in answers]


class VerdictReranker:
    """A chat model asked for yes or no in place of a reranker."""

    def __init__(self, completer: Completer, question: str = "Do these two texts describe the same problem? Answer yes or no.\n1: {}\n2: {}") -> None:
        self.completer, self.question = completer, question

    def score(self, pairs: list[tuple[str, str]]) -> list[float]:
        return [verdict_score(a) for a in self.completer.complete([self.question.format(*p) for p in pairs])]


class FirstWorking:
    """Rerankers in order of preference: the first whose call does not fail answers."""

    def __init__(self, rerankers: list[Reranker]) -> None:
        if not rerankers:
            raise ValueError("no reranker")
        self.rerankers = rerankers

    def score(self, pairs: list[tuple[str, str]]) -> list[float]:
        for reranker in self.rerankers[:-1]:
            try:
                return reranker.score(pairs)
            except Exception:
                continue
        return self.rerankers[-1].score(pairs)


class HashedNgrams:
    """Vectors of hashed character trigrams, of length 1: texts that share trigrams are similar."""

    def __init__(self, dimensions: int = 64) -> None:
        self.dimensions = dimensions
        self.known: dict[str, int] = {}

    def encode(self, texts: list[str]) -> np.ndarray:
        n, known, cells = self.dimensions, self.known, []
        if len(known) > KNOWN_TRIGRAMS:
            known.clear()
        for row, text in enumerate(texts):
            padded = f"  {text.lower()} "
            for i in range(len(padded) - 2):
                gram = padded[i : i + 3]
                if gram not in known:
                    h = int.from_bytes(hashlib.blake2b(gram.encode(), digest_size=8).digest(), "big")
                    known[gram] = h % n + (n if h >> 63 else 0)
                cells.append(2 * n * row + known[gram])
        counts = np.bincount(np.array(cells, dtype=np.int64), minlength=2 * n * len(texts)).reshape(len(texts), 2, n)
        out = (counts[:, 1] - counts[:, 0]).astype(np.float64)
        length = np.linalg.norm(out, axis=1, keepdims=True)
        return np.divide(out, length, out=np.zeros_like(out), where=length > 0)


class CosineReranker:
    """Similarity of hashed vectors in place of a reranking model."""

    def __init__(self) -> None:
        self.encoder = HashedNgrams()
        self.known: dict[str, np.ndarray] = {}

    def score(self, pairs: list[tuple[str, str]]) -> list[float]:
        if not pairs:
            return []
        if len(self.known) > KNOWN_TEXTS:
            self.known.clear()
        new = [t for t in dict.fromkeys(t for p in pairs for t in p) if t not in self.known]
        self.known.update(zip(new, self.encoder.encode(new), strict=True))
        a, b = (np.array([self.known[p[i]] for p in pairs]) for i in (0, 1))
        return (a * b).sum(1).tolist()


class EchoCompleter:
    """Answers every prompt with an empty extraction: the shape of an answer without its content."""

    def complete(self, prompts: list[str]) -> list[str]:
        return [json.dumps({"has_opinion": False, "aspects": []}) for _ in prompts]


class RuleCompleter:
    """Stand-in for an extraction model: the seeds that the sentence of a prompt names are its aspects, in the order of the list."""

    def complete(self, prompts: list[str]) -> list[str]:
        answers = []
        for prompt in prompts:
            found = re.search(r"^Sentence: (.*)$", prompt, re.MULTILINE)
            sentence = found.group(1) if found else ""
            lower = sentence.lower()
            positive, negative = sum(w in lower for w in lx.POSITIVE), sum(w in lower for w in lx.NEGATIVE)
            sentiment = "positive" if positive > negative else "negative" if negative > positive else "neutral"
            aspects = [{"aspect": s, "sentiment": sentiment, "sentiment_score": 0.5, "issue": sentence[:40], "evidence_text": sentence[:100]} for s in lx.ASPECT_SEEDS if s in lower]
            answers.append(json.dumps({"has_opinion": bool(aspects), "aspects": aspects}, ensure_ascii=False))
        return answers


def build_completer(config: ModelConfig) -> Callable[[], Completer]:
    """What a worker calls to build the model of a configuration; `rules` and `echo` are the stand-ins."""
    stand_ins = {"rules": RuleCompleter, "echo": EchoCompleter}
    if config.provider in stand_ins:
        return stand_ins[config.provider]
    if config.provider not in BASE_URLS:
        raise ValueError(f"unsupported provider {config.provider}")
    return lambda: ChatModel(config)


#: Fields of a structured answer: name to (type, default); without a default the field must be there.
Fields = dict[str, tuple]
EXTRACTION_FIELDS: Fields = {"has_opinion": (bool,), "aspects": (list, []), "language": (str, "en"), "extraction_warnings": (list, [])}
ASPECT_FIELDS: Fields = {"aspect": (str,), "sentiment": (str,), "sentiment_score": (float, 0.0), "issue": (str,), "evidence_text": (str,), "confidence": (float, 0.5)}
NORMALIZATION_FIELDS: Fields = {"normalized_aspect": (str,), "confidence": (float,), "reasoning": (str, None), "is_noise": (bool, False), "should_add_to_taxonomy": (bool, False), "is_new_aspect": (bool, False)}


def with_example(prompt: str, fields: Fields) -> str:
    """A prompt that ends in the wish for pure JSON and an example of its fields, for models without a schema of their own."""
    empty = {str: "", int: 0, float: 0.0, bool: False, list: [], dict: {}}
    example = json.dumps({name: empty[kind[0]] for name, kind in fields.items()}, indent=2)
    return f"{prompt}\n\nAnswer with JSON of exactly this form, without any text or code marks around it; use null or an empty text where there is no value:\n{example}"


def structured(answer: str | None, fields: Fields) -> dict:
    """An answer as its declared fields: found inside other text too, defaults filled in, numbers read from text.

    A missing field without a default, or a value of another type, is a ValueError.
    """
    value = decode(answer)
    if not isinstance(value, dict):
        raise ValueError("no object")
    out = {}
    for name, (kind, *default) in fields.items():
        held = value.get(name)
        if held is None:
            if not default:
                raise ValueError(f"{name} is missing")
            out[name] = default[0]
            continue
        try:
            out[name] = held if isinstance(held, kind) and not (kind is float and isinstance(held, bool)) else float(held) if kind is float and not isinstance(held, (list, dict)) else None
        except ValueError:
            out[name] = None
        if out[name] is None:
            raise ValueError(f"{name} is no {kind.__name__}")
    return out


def structured_extraction(answer: str | None) -> dict:
    """An extraction with its aspects checked one by one."""
    out = structured(answer, EXTRACTION_FIELDS)
    return out | {"aspects": [structured(json.dumps(a), ASPECT_FIELDS) for a in out["aspects"]]}


def fill_template(template: str, columns: list[str]) -> F.Column:
    """A prompt template whose `{column}` marks are filled from a row, NULL as empty text; `{{` and `}}` are braces."""
    parts = re.split(r"(\{\{|\}\}|\{[a-z_]+\})", template)
    filled = []
    for part in parts:
        if part in ("{{", "}}"):
            filled.append(F.lit(part[0]))
        elif re.fullmatch(r"\{[a-z_]+\}", part):
            if part[1:-1] not in columns:
                raise ValueError(f"the template asks for {part}")
            filled.append(F.coalesce(F.col(part[1:-1]).cast("string"), F.lit("")))
        elif part:
            filled.append(F.lit(part))
    return F.concat(*filled)


def verdict_score(answer: str | None) -> float:
    """Score of a model's yes-or-no verdict on a pair: 0.8, 0.2, 0.5 if unclear, 0 if it failed."""
    if answer is None:
        return 0.0
    word = answer.strip().lower()
    return 0.8 if word.startswith("yes") else 0.2 if word.startswith("no") else 0.5


def retried(call: Callable, times: int = 3, delay: float = 1.0, factor: float = 2.0, sleep: Callable[[float], None] = time.sleep) -> Callable:
    """`call` with up to `times` repetitions after errors, each after a longer pause; the last error is raised."""

    def run(*args: object, **kwargs: object) -> object:
        pause = delay
        for attempt in range(times + 1):
            try:
                return call(*args, **kwargs)
            except Exception:
                if attempt == times:
                    raise
                sleep(pause)
                pause *= factor
        return None

    return run


def encode_texts(df: DataFrame, text: str, build: Callable[[], Embedder] = HashedNgrams, dimensions: int | None = None, instruction: str = "") -> DataFrame:
    """(text, vector): one vector of length 1 per different text, cut to the first dimensions before scaling."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encode = retried(build().encode)
        for frame in frames:
            for start in range(0, len(frame), BATCH):
                part = frame.iloc[start : start + BATCH]
                v = np.asarray(encode([instruction + t for t in part["text"]]), dtype=np.float64)[:, :dimensions]
                length = np.linalg.norm(v, axis=1, keepdims=True)
                unit = np.divide(v, length, out=np.zeros_like(v), where=length > 0)
                yield pd.DataFrame({"text": part["text"], "vector": list(unit)})

    return df.select(F.col(text).alias("text")).where("text is not null").distinct().mapInPandas(run, "text string, vector array<double>")


def reranked(frames: Iterator[pd.DataFrame], left: str, right: str, build: Callable[[], Reranker]) -> Iterator[pd.DataFrame]:
    """Frames of pairs with their `rerank_score`, as `rerank` has them."""
    reranker = build()

    def checked(part: list[tuple[str, str]]) -> list[float]:
        values = [float(x) for x in reranker.score(part)]
        if len(values) != len(part) or not np.isfinite(values).all():
            raise ValueError(f"{len(part)} pairs, {np.isfinite(values).sum()} scores")
        return values

    score = retried(checked)
    for frame in frames:
        values = np.full(len(frame), np.nan)
        whole = np.flatnonzero(frame[left].notna() & frame[right].notna())
        pairs = list(zip(frame[left].to_numpy()[whole], frame[right].to_numpy()[whole], strict=True))
        for start in range(0, len(pairs), BATCH):
            values[whole[start : start + BATCH]] = score(pairs[start : start + BATCH])
        yield frame.assign(rerank_score=values)


def rerank(pairs: DataFrame, left: str, right: str, build: Callable[[], Reranker] = CosineReranker) -> DataFrame:
    """Adds `rerank_score` to pairs of texts, NULL where a text is NULL.

    A batch that fails again and again, or has no score for every pair, is an error: a failed pair must not look like an unlike one.
    """
    from pyspark.sql.types import DoubleType, StructField, StructType

    return pairs.mapInPandas(lambda frames: reranked(frames, left, right, build), StructType([*pairs.schema.fields, StructField("rerank_score", DoubleType())]))


def complete_prompts(df: DataFrame, key: str, prompt: str, build: Callable[[], Completer] = RuleCompleter, retries: int = 3, check: Callable[[str], dict] = structured_extraction) -> DataFrame:
    """(key, parse_status, retry_count, error_type, llm_output) per prompt.

    An answer that `check` refuses is asked for again; the accepted one is written as it was checked. A prompt without any
    acceptable answer is FAIL with its last error, the last answer and all retries.
    """
    kind = df.schema[key].dataType.simpleString()

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = build()
        for frame in frames:
            rows = []
            for k, text in zip(frame[key], frame[prompt], strict=True):
                status, error, answer, used = "FAIL", None, None, 0
                for used in range(retries + 1):  # noqa: B007
                    try:
                        answer = model.complete([text])[0]
                        answer = json.dumps(check(answer), ensure_ascii=False)
                        status, error = "SUCCESS", None
                        break
                    except Exception as e:
                        error = type(e).__name__
                rows.append((k, status, used, error, answer))
            yield pd.DataFrame(rows, columns=[key, "parse_status", "retry_count", "error_type", "llm_output"])

    return df.select(key, prompt).mapInPandas(run, f"{key} {kind}, parse_status string, retry_count int, error_type string, llm_output string")
