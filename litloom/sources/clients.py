"""Outside services behind plain callables, with deterministic stand-ins for work without a network.

Calls run in ``mapInPandas``; a failed call becomes a row with an error, it doesn't fail the task.
"""

from __future__ import annotations

import functools
import hashlib
import inspect
import json
import re
import time
import urllib.request
import uuid
from collections.abc import Callable
from dataclasses import dataclass
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import DEFAULT


def hashing_embedder(texts: list[str], dim: int = DEFAULT.embedding_dim) -> list[list[float]]:
    """Unit vectors of hashed word counts: equal texts get equal vectors on every machine."""
    out = []
    for text in texts:
        v = np.zeros(dim)
        for w in re.findall(r"\w+", (text or "").lower()):
            h = int.from_bytes(hashlib.blake2b(w.encode(), digest_size=8).digest(), "big")
            v[h % dim] += 1.0 if h >> 63 else -1.0
        n = np.linalg.norm(v)
        out.append((v / n if n else v).astype(np.float32).tolist())
    return out


def embedded(text: Column, embed: Callable[[list[str]], list[list[float]]] = hashing_embedder, dim: int = DEFAULT.embedding_dim) -> Column:
    """Vectors of texts in their order; a wrong number or width of vectors is an error."""

    @F.pandas_udf("array<float>")
    def run(values: pd.Series) -> pd.Series:
        vectors = embed(list(values))
        if len(vectors) != len(values):
            raise ValueError(f"{len(vectors)} vectors for {len(values)} texts")
        if any(len(v) != dim for v in vectors):
            raise ValueError(f"vectors must have {dim} components")
        return pd.Series(vectors)

    return run(text)


def with_retries(call: Callable[[object], str], attempts: int = 3, pause: float = 2.0, retry_on: tuple[type[Exception], ...] = (OSError,)) -> Callable[[object], str]:
    """``call`` tried again after growing pauses on connection errors (``OSError`` and what derives from it: connections,
    time-outs, HTTP errors); an empty answer is an error at once."""

    def run(x: object) -> str:
        for i in range(attempts):
            try:
                answer = call(x)
                break
            except retry_on:
                if i == attempts - 1:
                    raise
                time.sleep(pause * (i + 1))
        if not answer or isinstance(answer, str) and not answer.strip():
            raise ValueError("empty answer")
        return answer

    return run


@dataclass(frozen=True)
class DocumentParser:
    """Client of a document-parser service: bytes of a document to TEI XML, with coordinates of paragraphs.

    A plain callable that travels to the tasks; connection errors are tried again, see ``with_retries``.
    """

    url: str
    consolidate_header: bool = True
    consolidate_citations: bool = False
    segment_sentences: bool = False
    timeout: float = 300.0
    attempts: int = 3
    pause: float = 2.0

    def alive(self) -> bool:
        """Does the service answer that it lives? An unreachable one does not."""
        try:
            with urllib.request.urlopen(f"{self.url}/api/isalive", timeout=10) as answer:
                return "true" in answer.read().decode("utf-8", "replace").lower()
        except OSError:
            return False

    def fields(self) -> dict[str, str]:
        out = {"consolidateHeader": str(int(self.consolidate_header)), "consolidateCitations": str(int(self.consolidate_citations)), "teiCoordinates": "p", "includeRawAffiliations": "0"}
        return out | ({"segmentSentences": "1"} if self.segment_sentences else {})

    def _post(self, content: bytes) -> str:
        mark = uuid.uuid4().hex
        parts = [f'--{mark}\r\nContent-Disposition: form-data; name="{k}"\r\n\r\n{v}\r\n'.encode() for k, v in self.fields().items()]
        parts += [f'--{mark}\r\nContent-Disposition: form-data; name="input"; filename="document.pdf"\r\nContent-Type: application/pdf\r\n\r\n'.encode(), content, f"\r\n--{mark}--\r\n".encode()]
        request = urllib.request.Request(f"{self.url}/api/processFulltextDocument", b"".join(parts), {"Content-Type": f"multipart/form-data; boundary={mark}"})
        with urllib.request.urlopen(request, timeout=self.timeout) as answer:
            return answer.read().decode("utf-8")

    def __call__(self, content: bytes) -> str:
        return with_retries(self._post, self.attempts, self.pause)(content)


class Answer(NamedTuple):
    """What a language model said and how many tokens it read and wrote, where it tells."""

    text: str | None
    tokens_in: int | None = None
    tokens_out: int | None = None


@dataclass(frozen=True)
class Policy:
    """What a model is told beforehand, and how freely it may answer."""

    temperature: float
    system: str


EXTRACTION_POLICY = Policy(
    0.0, "You fill in one row of a table about a paper. Record only what its text says, in its own words. Leave a field null if the text is silent on it: null is right, a guess is wrong. Quotes are literal."
)
SYNTHESIS_POLICY = Policy(
    0.3, "You weigh the findings of several papers against each other. Rest every statement on the passages given and name the citekeys it rests on, no others. Where they don't suffice, say so."
)


@dataclass(frozen=True)
class ChatModel:
    """Client of a chat-completions service; called with a prompt and a policy it answers with text and token counts."""

    url: str
    model: str
    key: str = ""
    max_tokens: int = 4096
    timeout: float = 300.0

    def __call__(self, prompt: object, policy: Policy = EXTRACTION_POLICY) -> Answer:
        body = {"model": self.model, "temperature": policy.temperature, "max_tokens": self.max_tokens, "messages": [{"role": "system", "content": policy.system}, {"role": "user", "content": str(prompt)}]}
        headers = {"Content-Type": "application/json"} | ({"Authorization": f"Bearer {self.key}"} if self.key else {})
        request = urllib.request.Request(f"{self.url}/chat/completions", json.dumps(body).encode(), headers)
        with urllib.request.urlopen(request, timeout=self.timeout) as answer:
            told = json.loads(answer.read())
        usage = told.get("usage") or {}
        return Answer(told["choices"][0]["message"]["content"], usage.get("prompt_tokens"), usage.get("completion_tokens"))


def under(policy: Policy, chat: Callable) -> Callable[[object], object]:
    """A model's callable bound to a policy, if it takes one; others (stand-ins, local functions) are left as they are."""
    try:
        takes = "policy" in inspect.signature(chat).parameters
    except (TypeError, ValueError):
        takes = False
    return functools.partial(chat, policy=policy) if takes else chat


def call_rows(rows: DataFrame, key: str, value: str, call: Callable[[object], object], result: str = "answer") -> DataFrame:
    """``(key, <result>, error, tokens_in, tokens_out)``: the answer of an outside service for each row, or why there is none.

    The service answers with a text or an ``Answer``; token counts it doesn't tell are null."""

    def run(batches):
        for b in batches:
            answers, errors = [], []
            for v in b[value]:
                try:
                    told = call(v)
                    answers.append(told if isinstance(told, Answer) else Answer(told))
                    errors.append(None)
                except Exception as e:  # noqa: BLE001 - told in the row
                    answers.append(Answer(None))
                    errors.append(str(e) or type(e).__name__)
            columns = {result: [a.text for a in answers], "error": errors, "tokens_in": [a.tokens_in for a in answers], "tokens_out": [a.tokens_out for a in answers]}
            yield pd.DataFrame({key: b[key], **{c: pd.Series(v, dtype=object, index=b.index) for c, v in columns.items()}})

    kind = rows.schema[key].dataType.simpleString()
    return rows.select(key, value).mapInPandas(run, f"`{key}` {kind}, `{result}` string, error string, tokens_in int, tokens_out int")


#: What a concept extraction answers, field by field; null says that the paper doesn't state it.
EXTRACTION_ANSWER = (
    "research_question string, theoretical_lens string, method string, constructs array<string>, key_finding string, stated_limitation string, "
    "future_work_suggested string, context_sector string, supporting_quote string, quote_page string, model_used string"
)


def extract_concepts(evidence: DataFrame, call: Callable[[object], object], model: str) -> DataFrame:
    """``(paper_id, <answer fields>, error, tokens_in, tokens_out)`` of ``(paper_id, evidence)``; ``model_used`` is always the
    configured model."""
    answers = call_rows(evidence, "paper_id", "evidence", call)
    told = answers.withColumn("a", F.from_json("answer", EXTRACTION_ANSWER + ", _corrupt_record string"))
    names = [f.split()[0] for f in EXTRACTION_ANSWER.split(", ")]
    fields = [F.coalesce(F.col("a.constructs"), F.array().cast("array<string>")).alias("constructs") if n == "constructs" else F.lit(model).alias(n) if n == "model_used" else F.col(f"a.{n}").alias(n) for n in names]
    bad = F.when(F.col("error").isNull() & (F.col("a").isNull() | F.col("a._corrupt_record").isNotNull()), "unreadable answer").otherwise(F.col("error"))
    return told.select("paper_id", *fields, bad.alias("error"), "tokens_in", "tokens_out")


def steelman(evidence: str, gap: str, call: Callable[[object], object]) -> dict:
    """The strongest objection to a claimed gap, with the tokens it took; without evidence a fixed answer that the gap has
    not survived a test."""
    if not gap or not gap.strip():
        raise ValueError("the gap is blank")
    if not evidence or not evidence.strip():
        return {"gap_survives": False, "counter_argument": "No passage was found that bears on this gap.", "tokens": (None, None)}
    told = call(f"Claimed gap: {gap}\n\nPassages:\n{evidence}")
    told = told if isinstance(told, Answer) else Answer(told)
    answer = json.loads(told.text)
    return {"gap_survives": bool(answer.get("gap_survives")), "counter_argument": answer.get("counter_argument"), "tokens": (told.tokens_in, told.tokens_out)}
