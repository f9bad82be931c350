"""Model calls behind replaceable providers.

A provider turns columns into a column. The deterministic ones here let every pipeline run
without a network; they stand in for models and make no claim of model quality. The
``Remote*`` ones batch calls to a user's client inside the tasks.
"""

from __future__ import annotations

import hashlib
import re
import time
from collections import Counter
from collections.abc import Callable, Iterator
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.text import (
    clamp_salience, display_triple, normalize_entity, strip_space, utf16_left, valid_types,
)

EXTRACTION = (
    "struct<summary:string,triples:array<struct<subject:string,predicate:string,object:string>>,"
    "types:array<string>,topics:array<string>,salience:double>"
)
FALLBACK_CHARS = 200
RETRY_WAITS = (20.0, 40.0, 60.0)


class Embedder(Protocol):
    def column(self, text: Column, input_type: str = "document") -> Column: ...


class Extractor(Protocol):
    def column(self, text: Column) -> Column: ...


class TripleFilter(Protocol):
    """1-based positions of the relevant candidates; null keeps them all."""

    def positions(self, query: Column, candidates: Column) -> Column: ...


class Judge(Protocol):
    def reply(self, question: Column, expected: Column, answer: Column) -> Column: ...


def rate_limited(error: Exception) -> bool:
    return "429" in str(error) or "Too Many Requests" in str(error) or getattr(error, "status_code", None) == 429


def with_retry(call: Callable, *args, waits=RETRY_WAITS, sleep=time.sleep):
    """Repeat ``call`` after a rate limit, waiting longer each time; other errors pass."""
    for wait in (*waits, None):
        try:
            return call(*args)
        except Exception as error:
            if wait is None or not rate_limited(error):
                raise
            sleep(wait)


class HashEmbedder:
    """Signed counts of letter trigrams in ``dim`` buckets: a stand-in for a model.

    Similar spellings get similar vectors. Components are whole numbers, so dot products are
    exact and texts with equal trigrams tie exactly.
    """

    def __init__(self, dim: int = 128):
        self.dim = dim

    def column(self, text: Column, input_type: str = "document") -> Column:
        dim = self.dim

        @F.pandas_udf("array<double>")
        def embed(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
            known: dict[str, np.ndarray] = {}

            def word_vector(word: str) -> np.ndarray:
                if word not in known:
                    if len(known) > 100_000:
                        known.clear()
                    v, padded = np.zeros(dim), f"#{word}#"
                    for i in range(len(word)):
                        h = hashlib.md5(padded[i : i + 3].encode()).hexdigest()
                        v[int(h[:4], 16) % dim] += 1.0 if int(h[4], 16) < 8 else -1.0
                    known[word] = v
                return known[word]

            def one(t: str | None) -> np.ndarray | None:
                if t is None:
                    return None
                v = np.zeros(dim)
                for word in t.split(" "):
                    if word:
                        v += word_vector(word)
                return v

            for s in batches:
                yield s.map(one)

        return embed(F.regexp_replace(F.lower(text), r"\s+", " "))


class RemoteEmbedder:
    """``call(texts, input_type) -> vectors`` in batches, with rate-limit retries."""

    def __init__(self, call: Callable[[list[str], str], list[list[float]]], batch: int = 128):
        self.call, self.batch = call, batch

    def column(self, text: Column, input_type: str = "document") -> Column:
        call, batch = self.call, self.batch

        @F.pandas_udf("array<double>")
        def embed(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
            for s in batches:
                texts, out = s.tolist(), []
                for i in range(0, len(texts), batch):
                    out += with_retry(call, texts[i : i + batch], input_type)
                yield pd.Series(out, dtype=object)

        return embed(text)


def clean_extraction(raw: Column, text: Column) -> Column:
    """Normalize an extractor's answer; without one, keep the head of the text and no triples.

    ``failed`` marks the texts without an answer, so that a caller can count them and ask again for those alone.
    """
    triples = F.transform(
        F.coalesce(raw["triples"], F.array().cast("array<struct<subject:string,predicate:string,object:string>>")),
        lambda t: F.struct(
            normalize_entity(t["subject"]).alias("subject"),
            normalize_entity(t["predicate"]).alias("predicate"),
            normalize_entity(t["object"]).alias("object"),
        ),
    )
    topics = F.transform(F.coalesce(raw["topics"], F.array().cast("array<string>")), normalize_entity)
    return F.struct(
        F.coalesce(strip_space(raw["summary"]), utf16_left(text, FALLBACK_CHARS)).alias("summary"),
        triples.alias("triples"),
        valid_types(raw["types"]).alias("types"),
        topics.alias("topics"),
        clamp_salience(raw["salience"]).alias("salience"),
        raw["summary"].isNull().alias("failed"),
    )


def word_finder(word: str, letter: str, least: int) -> Callable[[str], list[str]]:
    """``re.findall(word, text)`` for ``word`` = ``letter`` repeated ``least`` times or more.

    A class of ranges is matched by one look at a table, one of categories by several calls per character. The table ends at
    U+FFFF, so the few texts with later characters are read by ``word`` itself.
    """
    single, ranges = re.compile(letter), []
    for c in range(0x10000):
        if single.match(chr(c)):
            if ranges and ranges[-1][1] == c - 1:
                ranges[-1][1] = c
            else:
                ranges.append([c, c])
    spans = "".join(f"{re.escape(chr(a))}-{re.escape(chr(b))}" for a, b in ranges)
    plain, every = re.compile(f"[{spans}]{{{least},}}"), re.compile(word)

    def find(text: str) -> list[str]:
        short = text.isascii() or len(text.encode("utf-16-le", "surrogatepass")) == 2 * len(text)
        return (plain if short else every).findall(text)

    return find


class KeywordExtractor:
    """Chains the text's most frequent words into triples; a stand-in for model extraction.

    The summary has a quarter of the words, so it grows with the text. Triples and topics are at most five each: that is what the
    extraction contract asks of a model for one exchange.
    """

    LETTER, LEAST = r"[^\W\d_]", 4  # letters of any script
    WORD = f"{LETTER}{{{LEAST},}}"
    # Fixed values of the extraction contract.
    COMPRESSION, ENTITIES, TOPICS = 4, 6, 5
    PREDICATE = "relates to"

    def column(self, text: Column) -> Column:
        words, share, n_ent, n_top = word_finder(self.WORD, self.LETTER, self.LEAST), self.COMPRESSION, self.ENTITIES, self.TOPICS
        predicate = self.PREDICATE

        @F.pandas_udf(EXTRACTION)
        def extract(texts: pd.Series) -> pd.DataFrame:
            rows = []
            for t in texts:
                counts = Counter(words(t or ""))
                ranked = sorted(counts)
                ranked.sort(key=counts.__getitem__, reverse=True)  # stable: equal counts stay in order of the words
                ents = ranked[:n_ent]
                types = [k for k, mark in (("event", "0123456789"), ("goal", "?")) if any(c in (t or "") for c in mark)]
                rows.append((
                    " ".join(ranked[: -(-counts.total() // share)]),
                    [{"subject": a, "predicate": predicate, "object": b} for a, b in zip(ents, ents[1:])],
                    types, ranked[:n_top], len(counts) / max(1, counts.total()),
                ))
            return pd.DataFrame(rows, columns=["summary", "triples", "types", "topics", "salience"])

        return clean_extraction(extract(F.lower(text)), text)


class RemoteExtractor:
    """``call(text) -> dict``; a failed call yields the fallback instead of failing the job."""

    def __init__(self, call: Callable[[str], dict]):
        self.call = call

    def column(self, text: Column) -> Column:
        call, names = self.call, ["summary", "triples", "types", "topics", "salience"]

        @F.pandas_udf(EXTRACTION)
        def extract(texts: pd.Series) -> pd.DataFrame:
            def one(t):
                try:
                    got = with_retry(call, t)
                    return [got.get(n) for n in names]
                except Exception:
                    return [None] * len(names)

            return pd.DataFrame([one(t) for t in texts], columns=names).astype(object)

        return clean_extraction(extract(text), text)


class Summarizer(Protocol):
    def column(self, text: Column, target_tokens: Column) -> Column: ...


class KeywordSummarizer:
    """Stand-in summary: the text's distinct words of four or more letters, as many as tokens allowed."""

    def column(self, text: Column, target_tokens: Column) -> Column:
        words = F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit(r"(\p{L}{4,})"), 1))
        return F.array_join(F.slice(words, F.lit(1), target_tokens.cast("int")), " ")


class RemoteSummarizer:
    """``call(text, target_tokens) -> summary`` per row, with rate-limit retries."""

    def __init__(self, call: Callable[[str, int], str]):
        self.call = call

    def column(self, text: Column, target_tokens: Column) -> Column:
        call = self.call

        @F.pandas_udf("string")
        def summarize(texts: pd.Series, targets: pd.Series) -> pd.Series:
            return pd.Series([with_retry(call, t, int(n)).strip() for t, n in zip(texts, targets)], dtype=object)

        return summarize(text, target_tokens)


class KeepAll:
    def positions(self, query: Column, candidates: Column) -> Column:
        return F.lit(None).cast("array<int>")


class SharedWordFilter:
    """Stand-in recognition: candidates naming at least one word of the query."""

    def positions(self, query: Column, candidates: Column) -> Column:
        words = F.split(F.lower(query), r"\s+")
        hit = lambda t: F.arrays_overlap(
            words, F.split(F.concat_ws(" ", t["subject"], t["predicate"], t["object"]), r"\s+")
        )
        flags = F.transform(candidates, lambda t, i: F.when(hit(t), i + 1))
        return F.filter(flags, lambda i: i.isNotNull()).cast("array<int>")


class RemoteTripleFilter:
    """``call(query, lines) -> positions`` for candidates numbered from 1; a failed call, or at most two candidates, keeps all."""

    KEEP_ALL = 2

    def __init__(self, call: Callable[[str, list[str]], list[int]]):
        self.call = call

    def positions(self, query: Column, candidates: Column) -> Column:
        call, few = self.call, self.KEEP_ALL
        lines = F.transform(candidates, lambda t, i: display_triple(i + 1, t["subject"], t["predicate"], t["object"]))

        @F.pandas_udf("array<int>")
        def choose(queries: pd.Series, listed: pd.Series) -> pd.Series:
            def one(q, found):
                if len(found) <= few:
                    return None
                try:
                    return [int(i) for i in with_retry(call, q, list(found))]
                except Exception:
                    return None

            return pd.Series([one(q, found) for q, found in zip(queries, listed)], dtype=object)

        return choose(query, lines)


class RemoteReranker:
    """``call(query, chunks) -> scores`` as a scorer of ``chunking.rerank_and_pack``; chunks of one query in a batch share a call."""

    def __init__(self, call: Callable[[str, list[str]], list[float]], batch: int = 1000):
        self.call, self.batch = call, batch

    def __call__(self, query: Column, chunk: Column) -> Column:
        call, batch = self.call, self.batch

        @F.pandas_udf("double")
        def score(queries: pd.Series, chunks: pd.Series) -> pd.Series:
            out = pd.Series(0.0, index=queries.index)
            for q, at in queries.groupby(queries, sort=False).groups.items():
                for i in range(0, len(at), batch):
                    part = at[i : i + batch]
                    out.loc[part] = [float(x) for x in with_retry(call, q, chunks.loc[part].tolist())]
            return out

        return score(query, chunk)


class RemoteJudge:
    """``call(question, expected, answer) -> reply``, read by ``verdict_is_correct``; a failed call judges the answer wrong."""

    def __init__(self, call: Callable[[str, str, str], str]):
        self.call = call

    def reply(self, question: Column, expected: Column, answer: Column) -> Column:
        call = self.call

        @F.pandas_udf("string")
        def judge(questions: pd.Series, wanted: pd.Series, given: pd.Series) -> pd.Series:
            def one(*row):
                try:
                    return with_retry(call, *row)
                except Exception:
                    return "INCORRECT"

            return pd.Series([one(*row) for row in zip(questions, wanted, given)], dtype=object)

        return judge(question, expected, answer)


class ContainsJudge:
    """Stand-in verdict: the answer contains the expected text."""

    def reply(self, question: Column, expected: Column, answer: Column) -> Column:
        return F.when(F.contains(F.lower(answer), F.lower(expected)), F.lit("CORRECT")).otherwise(F.lit("INCORRECT"))


def term_overlap(query: Column, chunk: Column) -> Column:
    """Stand-in relevance: number of distinct query words in the chunk."""
    words = lambda c: F.array_distinct(F.split(F.lower(c), r"\s+"))
    return F.size(F.array_intersect(words(query), words(chunk))).cast("double")


class ProviderRegistry:
    """The three model tiers plus the embedding, extraction and rerank connectors by name."""

    def __init__(self, **providers):
        self._providers = {
            "embedder": HashEmbedder(), "extractor": KeywordExtractor(),
            "triple_filter": KeepAll(), "summarizer": KeywordSummarizer(), "judge": ContainsJudge(),
            "reranker": term_overlap, **providers,
        }

    def __getitem__(self, name: str):
        if name not in self._providers:
            raise KeyError(f"no provider named {name!r}")
        return self._providers[name]
