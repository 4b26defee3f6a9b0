"""Where texts are judged: by a rule, by recorded replies or by a model server.

A relation provider takes chosen pairs and returns them with a column relation.
Results of a provider that costs something are to be written to a table right after.
"""

from __future__ import annotations

import json
import time
import urllib.error
import urllib.request
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from typing import Protocol

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from argolith.config import Profile
from argolith.functions.text import term_counts, tokens

#: Words that mark contrast.
CONTRAST = ("but", "however", "not", "no", "never", "although", "wrong", "instead")


class RelationProvider(Protocol):
    def label(self, pacs: DataFrame) -> DataFrame: ...


class Client(Protocol):
    """Where prompts are answered: prompts (..., system, temperature, prompt) get a column raw and lose the prompt's."""

    def ask(self, prompts: DataFrame) -> DataFrame: ...


class EncoderProvider(Protocol):
    #: Whether vec is an array of numbers; else a map of terms.
    dense: bool

    def encode(self, edus: DataFrame) -> DataFrame: ...


@dataclass(frozen=True)
class Cue:
    """A rule for trying things out, no judge of arguments: a word of contrast in the source makes an attack, similarity support."""

    words: tuple[str, ...] = CONTRAST
    support_at: float = 0.25

    def label(self, pacs: DataFrame) -> DataFrame:
        contrast = F.arrays_overlap(tokens(F.col("source_text")), F.array(*map(F.lit, self.words)))
        return pacs.withColumn("relation", F.when(contrast, "attack").when(F.col("cosine_sim") >= self.support_at, "support").otherwise("neutral"))


@dataclass(frozen=True)
class Neutral:
    """What is left when no model answers."""

    def label(self, pacs: DataFrame) -> DataFrame:
        return pacs.withColumn("relation", F.lit("neutral"))


@dataclass(frozen=True)
class TableEncoder:
    """Vectors of a table (thread_id, global_idx, vec)."""

    vectors: DataFrame
    dense = True

    def encode(self, edus: DataFrame) -> DataFrame:
        return edus.join(self.vectors, ["thread_id", "global_idx"])


@dataclass(frozen=True)
class Lexical:
    """Word counts in place of learned vectors."""

    dense = False

    def encode(self, edus: DataFrame) -> DataFrame:
        return edus.withColumn("vec", term_counts(F.col("text")))


@dataclass(frozen=True)
class Scripted:
    """Replies that an expression makes of the columns of a prompt: for tests and dry runs."""

    reply: Callable[[], Column]

    def ask(self, prompts: DataFrame) -> DataFrame:
        return prompts.withColumn("raw", self.reply()).drop("system", "temperature", "prompt")


@dataclass(frozen=True)
class Recorded:
    """Replies of a table (*keys, raw), recorded before; a prompt without one gets no reply."""

    replies: DataFrame
    keys: tuple[str, ...] = ("batch_id", "call_no")

    def ask(self, prompts: DataFrame) -> DataFrame:
        return prompts.drop("system", "temperature", "prompt").join(self.replies.select(*self.keys, "raw"), list(self.keys), "left")


@dataclass(frozen=True)
class Server:
    """A model server; at most `slots` requests at a time. systems: the text of each system prompt."""

    url: str
    model: str
    systems: dict[str, str]
    slots: int = 4
    options: dict = field(default_factory=dict)
    timeout: float = 500
    tries: int = 2
    post: Callable | None = None

    def ask(self, prompts: DataFrame) -> DataFrame:
        def one(system: str, temperature: float, prompt: str) -> str | None:
            return chat(self.url, self.model, self.systems.get(system, ""), self.options | {"temperature": temperature}, self.timeout, self.tries, self.post, THINKING.get(system))(prompt)

        return ask_all(prompts, one, self.slots, ("system", "temperature", "prompt")).drop("system", "temperature", "prompt")


def server(url: str, profile: Profile, model: str | None = None, **options) -> Server:
    """A server with the prompts of a profile (its extras `prompts` and `reasoning`)."""
    prompts, reasoning = profile.extras.get("prompts", {}), profile.extras.get("reasoning", {})
    own = {"relations": "system", "tiebreak": "tiebreak", "cp_review": "cp_review"}
    systems = {k: str(v) for k, v in prompts.items()} | {k: str(reasoning.get(v, profile.extras.get(v, ""))) for k, v in own.items()}
    return Server(url, model or str(profile.extras.get("model", "")), systems, **options)


#: System prompts for which a model is told to think, or not to.
THINKING = {"segmentation": False, "central_proposition": True}


def chat(url: str, model: str, system: str, options: dict, timeout: float = 500, tries: int = 2, post: Callable | None = None, think: bool | None = None) -> Callable[[str], str | None]:
    """A function from a prompt to a reply, or null: tries again, after a pause, on a timeout or an empty reply only."""

    def send(body: bytes) -> str:
        request = urllib.request.Request(url, body, {"Content-Type": "application/json"})
        with urllib.request.urlopen(request, timeout=timeout) as r:
            return r.read().decode()

    def ask(prompt: str) -> str | None:
        body = json.dumps(({} if think is None else {"think": think}) | {"model": model, "stream": False, "format": "json", "options": options, "messages": [{"role": "system", "content": system}, {"role": "user", "content": prompt}]}).encode()
        for k in range(tries):
            try:
                if reply := json.loads((post or send)(body))["message"]["content"].split("</think>")[-1].strip():
                    return reply
            except TimeoutError:
                pass
            except (urllib.error.URLError, OSError, ValueError, KeyError) as e:
                if not isinstance(getattr(e, "reason", None), TimeoutError):
                    return None
            if k + 1 < tries:
                time.sleep(2**k)
        return None

    return ask


def ask_all(prompts: DataFrame, ask: Callable[..., str | None], slots: int, columns: tuple[str, ...] = ("prompt",)) -> DataFrame:
    """Adds raw, the reply to each prompt; at most `slots` requests at a time. ask takes the values of the columns."""
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in prompts.schema) + ", raw string"

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for x in frames:
            yield x.assign(raw=[ask(*p) for p in zip(*(x[c] for c in columns))])

    return prompts.repartition(slots).mapInPandas(run, schema)
