"""Models behind the extraction and evaluation operators.

A provider is a picklable object that a task calls on batches; the offline ones are deterministic
and need no network. Calls go through ``complete_with`` and ``embed_with``, so the plan around
them stays a plan: prompts in a column, replies in a column.
"""

from __future__ import annotations

import hashlib
import json
import re
import time
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared import release


class Completer(Protocol):
    def complete(self, prompt: str, temperature: float | None = None) -> str: ...


class Embedder(Protocol):
    def embed(self, texts: list[str]) -> np.ndarray: ...


class RateLimited(Exception):
    """The service asks to wait."""


@dataclass
class Retry:
    """How often a call is tried. ``everything``: other failures and replies that are not JSON are
    tried again, too, after a flat wait; else only a rate limit is, after waits that double."""

    tries: int = 3
    base_seconds: float = 60.0
    everything: bool = False
    sleep: Callable[[float], None] = field(default=time.sleep, repr=False)

    def call(self, model: Completer, prompt: str | None, want_json: bool = True, temperature: float | None = None) -> tuple[str | None, str | None]:
        """(reply, error); a null prompt is not asked and has neither."""
        error = None
        if prompt is None:
            return None, None
        more = {} if temperature is None else {"temperature": temperature}
        for attempt in range(self.tries):
            last = attempt == self.tries - 1
            try:
                reply = _unfenced(model.complete(prompt, **more))
                if want_json:
                    json.loads(reply)
                return reply, None
            except RateLimited as e:
                error = str(e) or "rate limited"
                if not last:
                    self.sleep(self.base_seconds * 2**attempt)
            except Exception as e:
                error = f"{type(e).__name__}: {e}"
                if not self.everything:
                    return None, error
                if not last:
                    self.sleep(self.base_seconds)
        return None, error


def _unfenced(reply: str) -> str:
    m = re.fullmatch(r"\s*```(?:json)?\s*(.*?)\s*```\s*", reply, re.DOTALL)
    return m[1] if m else reply


def complete_with(model: Completer, retry: Retry | None = None, want_json: bool = True, slots: int | None = None, temperature: float | None = None):
    """A function that adds ``reply`` and ``error`` to rows with a ``prompt``.

    ``slots`` spreads the calls over so many tasks, which bounds how many run at once.
    """
    policy = retry or Retry()

    def run(rows: DataFrame) -> DataFrame:
        rows = rows.repartition(slots) if slots else rows

        @F.pandas_udf(T.StructType().add("reply", T.StringType()).add("error", T.StringType()))
        def call(prompts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
            for batch in prompts:
                yield pd.DataFrame([policy.call(model, p, want_json, temperature) for p in batch], columns=["reply", "error"])
                del batch
                release()

        # a call is not repeated for each use of its reply
        return rows.withColumn("_r", call.asNondeterministic()(F.col("prompt"))).select("*", "_r.reply", "_r.error").drop("_r")

    return run


def embed_with(model: Embedder, text: Column, batch: int = 64) -> Column:
    """Vectors of a text column, in batches; a null text is embedded as an empty one."""

    @F.pandas_udf(T.ArrayType(T.FloatType()))
    def embed(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for part in parts:
            texts = part.fillna("").tolist()
            vectors = [v for i in range(0, len(texts), batch) for v in model.embed(texts[i : i + batch])]
            yield pd.Series([np.asarray(v, np.float32) for v in vectors])
            del part, texts, vectors
            release()

    return embed.asNondeterministic()(text)  # so that no filter on the vectors embeds every text again


@dataclass
class HashingEmbedder:
    """Signed counts of hashed words, of length one; zero for a text without words."""

    size: int = 64

    def embed(self, texts: list[str]) -> np.ndarray:
        out = np.zeros((len(texts), self.size))
        for row, text in zip(out, texts, strict=True):
            for word in re.findall(r"[a-z0-9]+", text.lower()):
                h = int.from_bytes(hashlib.blake2b(word.encode(), digest_size=8).digest(), "little")
                row[h % self.size] += 1 if h >> 63 else -1
            size = np.linalg.norm(row)
            if size:
                row /= size
        return out


@dataclass
class KeywordCompleter:
    """Replies to the extraction prompts by looking for sentences that share words with an event:
    those of ``hints``, else the longer words of its name."""

    hints: dict[str, list[str]] = field(default_factory=dict)

    def complete(self, prompt: str, temperature: float | None = None) -> str:
        text = prompt.partition("Text:\n")[2].partition("\nReply with JSON")[0] or prompt.partition("Passages:\n")[2].partition("\nReply with JSON")[0]
        author = re.search(r"^Author: (.*)$", prompt, re.MULTILINE)
        found = lambda event: self._sentences(text, event)
        one = re.search(r"^Event: (.*)$", prompt, re.MULTILINE)
        if one:
            return json.dumps(self._record(one[1], author[1], found(one[1])))
        events = re.findall(r"^- (.*)$", prompt.partition("Events:\n")[2].partition("\nText:")[0], re.MULTILINE)
        if "from each event's name" in prompt:
            return json.dumps({e: found(e) for e in events})
        return json.dumps({"extractions": [self._record(e, author[1], found(e)) for e in events]})

    def _sentences(self, text: str, event: str, most: int = 3) -> list[str]:
        words = set(self.hints.get(event) or (w for w in re.findall(r"[a-z]+", event.lower()) if len(w) > 4))
        return [s.strip() for s in re.split(r"(?<=[.!?])\s+", text) if words & set(re.findall(r"[a-z]+", s.lower()))][:most]

    @staticmethod
    def _record(event: str, author: str, claims: list[str]) -> dict:
        date = next(iter(re.findall(r"\b(?:1[0-9]{3})\b", " ".join(claims))), None)
        tone = "Neutral" if claims else "Not mentioned"
        return {"event": event, "author": author, "claims": claims, "temporal_details": {"date": date, "time": None}, "tone": tone}


@dataclass
class OverlapJudge:
    """Scores two lists of claims by the share of the author's words that the primary side has."""

    def complete(self, prompt: str, temperature: float | None = None) -> str:
        a, _, b = prompt.partition("\nReply with JSON")[0].partition("Author claims:")
        left, right = (set(re.findall(r"[a-z]{4,}", x.lower())) for x in (a, b))
        score = round(100 * len(left & right) / len(right)) if right else 0
        contradictions = [] if score >= 50 else [{"type": "omission", "reason": "few words in common"}]
        return json.dumps({"consistency_score": score, "contradictions": contradictions, "reasoning": "word overlap"})


_JUDGED = """
Event: {event}

Primary claims:
{lincoln_claims}

Author claims:
{author_claims}

Reply with JSON only:
{{"consistency_score": 0, "contradictions": [{{"type": "factual, interpretive or omission", "reason": "..."}}], "reasoning": "..."}}
"""
#: A template for each strategy of a work plan.
JUDGE_PROMPTS = {
    "zero_shot": "Compare an author's claims about an event with those of the primary sources, and score from 0 to 100 how well they agree.\n" + _JUDGED,
    "chain_of_thought": (
        "Compare an author's claims about an event with those of the primary sources, step by step: list what each side says, pair up what concerns "
        "the same thing, name each disagreement and its kind, and only then score from 0 to 100 how well they agree. Give the steps as the reasoning.\n" + _JUDGED
    ),
    "few_shot": (
        "Compare an author's claims about an event with those of the primary sources, and score from 0 to 100 how well they agree.\n\n"
        "Example: the sources say a speech was short and in the afternoon, the author says it took two minutes. Nothing disagrees: score 95.\n"
        "Example: the sources give one day, the author another, and the rest agrees: one factual contradiction, score 60.\n"
        "Example: the author tells of a meeting that the sources exclude: score 10.\n" + _JUDGED
    ),
}


def judge(
    work: DataFrame, model: Completer, templates: dict[str, str] | None = None, retry: Retry | None = None, temperature: float | None = None, complete=None
) -> DataFrame:
    """Scores of a work plan of pairs (event, primary_claims, author, author_claims, prompt_type, ...),
    each asked by its strategy's template; one try by default; a reply that cannot be read, or a
    strategy without a template, has a null score and an error. ``complete`` asks in place of the model
    itself, as one of a ledger does."""
    from .operators.extraction import claims_prompt

    prompt = F.lit(None).cast("string")
    for name, template in (templates or JUDGE_PROMPTS).items():
        filled = claims_prompt(template, F.col("primary_claims"), F.col("author_claims"), event=F.col("event"))
        prompt = F.when(F.col("prompt_type") == name, filled).otherwise(prompt)
    reply = "struct<consistency_score:double,contradictions:array<struct<type:string,reason:string>>,reasoning:string>"
    complete = complete or complete_with(model, retry or Retry(tries=1), temperature=temperature)
    scored = complete(work.withColumn("prompt", prompt)).withColumn("r", F.from_json("reply", reply))
    score = F.col("r.consistency_score")
    return scored.select(
        *work.columns, score.alias("score"), F.col("r.contradictions").alias("contradictions"), F.col("r.reasoning").alias("reasoning"),
        F.when(score.isNull(), F.coalesce("error", F.lit("no score in the reply"))).alias("error"),
    )


def expand_queries(events: DataFrame, model: Completer, most: int = 5) -> DataFrame:
    """(event_ord, event, query): up to ``most`` search queries for each event; the event itself where
    the reply has no list."""
    from .functions.prompts import reply_array

    prompt = F.concat(F.lit("List search queries, as a JSON list of strings, for the historical event: "), "event")
    replied = complete_with(model, Retry(), want_json=False)(events.withColumn("prompt", prompt))
    queries = reply_array(F.col("reply"), most)
    queries = F.when(F.size(queries) > 0, queries).otherwise(F.array("event"))
    return replied.select("event_ord", "event", F.explode(queries).alias("query"))
