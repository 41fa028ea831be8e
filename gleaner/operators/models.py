"""Operators around models: stance, document sentiment, frames and extraction.

A model is a function of a list of texts, loaded once a task.  Texts of one row are scored together in one Arrow pass, in
batches over rows, so nothing is shuffled.  A batch whose model fails has no scores.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce
from operator import add, truediv

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import patterns, text

#: Words of a text that a sentiment or frame model reads, paragraphs a document, texts in a batch.
MOST_WORDS, MOST_PARAGRAPHS, MOST_WINDOWS, BATCH = 512, 8, 5, 64
EXTRACT_WORDS = 3000  #: fixed value: words of a text that the extraction service reads

#: Scores of a batch of texts by label; it may raise.
LabelModel = Callable[[list[str]], list[dict[str, float]]]


def word_share_model(words: dict[str, tuple[str, ...]], share: Callable[[int, int], float] = truediv) -> LabelModel:
    """A deterministic stand-in: a label's smoothed share of the words of all labels.  With Fraction as share they are exact, so
    a difference of two is rounded once."""

    def score(texts: list[str]) -> list[dict[str, float]]:
        out = []
        for t in texts:
            w = t.lower().split()
            n = {label: 1 + sum(x in own for x in w) for label, own in words.items()}
            out.append({label: share(c, sum(n.values())) for label, c in n.items()})
        return out

    return score


def polarity_model(positive: tuple[str, ...], negative: tuple[str, ...]) -> LabelModel:
    """A deterministic stand-in with one label a text: positive, negative or neutral, and its confidence."""

    def score(texts: list[str]) -> list[dict[str, float]]:
        out = []
        for t in texts:
            w = t.lower().split()
            p, n = sum(x in positive for x in w), sum(x in negative for x in w)
            out.append({"neutral" if p == n else "positive" if p > n else "negative": abs(p - n) / (p + n) if p + n else 1.0})
        return out

    return score


def signed(scores: dict[str, float]) -> float:
    """Confidence of the one label: negative below 0, positive above, neutral 0."""
    label, confidence = max(scores.items(), key=lambda x: x[1])
    return -confidence if "negative" in label.lower() else confidence if "positive" in label.lower() else 0.0


def score_texts(df: DataFrame, load: Callable[[], LabelModel], column: str, value: Callable[[dict[str, float]], float], out: str, batch: int = BATCH) -> DataFrame:
    """df with out: the mean value over the texts of an array column; null without texts or scores.

    The array's size is a second argument so that the array is made before the model's call, not inside it.  Values are added one
    by one as in SQL: Python's sum() of floats is compensated.
    """

    @F.pandas_udf("double")
    def run(parts: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        model = load()
        for s, _ in parts:
            flat = [(k, t or "") for k, texts in enumerate(s) for t in (texts if texts is not None else ())]
            found: dict[int, list[float]] = {}
            for j in range(0, len(flat), batch):
                own = flat[j : j + batch]
                try:
                    scores = model([t for _, t in own])
                except Exception:  # noqa: BLE001  a model's failure is a missing score
                    continue
                for (k, _), x in zip(own, scores, strict=False):
                    found.setdefault(k, []).append(value(x))
            yield pd.Series([reduce(add, v) / len(v) if (v := found.get(k)) else None for k in range(len(s))], dtype="float64")

    return df.withColumn(out, run(F.col(column), F.size(column)))


def stance_paragraphs(body: Column, variants, generic: str, words: int | None = MOST_WORDS) -> Column:
    """Lines of over ten words that name the entity, then those that only refer to it; the first MOST_PARAGRAPHS, cut to so
    many words (None: whole)."""
    named = text.paragraphs(body, text.mention_pattern(variants), most=100_000)
    referring = text.paragraphs(body, generic, most=100_000)
    both = F.slice(F.concat(named, F.array_except(referring, named)), 1, MOST_PARAGRAPHS)
    return F.transform(both, lambda p: text.first_words(p, words)) if words else both


def stance(df: DataFrame, load: Callable[[], LabelModel], body: str, variants, generic: str, support: str, critical: str, out: str = "stance", words: int | None = MOST_WORDS) -> DataFrame:
    """df with out: mean of P(support) - P(critical) over the entity's paragraphs, of which the model reads so many words (None: all)."""
    rows = df.withColumn("_paragraphs", stance_paragraphs(F.col(body), variants, generic, words))
    return score_texts(rows, load, "_paragraphs", lambda x: float(x.get(support, 0) - x.get(critical, 0)), out).drop("_paragraphs")


def document_sentiment(df: DataFrame, load: Callable[[], LabelModel], body: str, out: str = "sentiment") -> DataFrame:
    """df with out: signed confidence over the text's first MOST_WORDS words."""
    rows = df.withColumn("_texts", F.array(text.first_words(F.coalesce(F.col(body), F.lit("")), MOST_WORDS)))
    return score_texts(rows, load, "_texts", signed, out).drop("_texts")


def frames(df: DataFrame, load: Callable[[], LabelModel], body: str, variants, names: dict[str, tuple[str, ...]]) -> DataFrame:
    """df with frame_<name>, dominant_frame and frame_method.

    The model scores every frame (several may hold) on the first MOST_WINDOWS windows of the entity, as one text.  Without
    windows, or where the model fails, the scores are shares of the frame's patterns in the body (names: patterns by frame).
    The greatest is dominant, the first of equal ones; with pattern scores that are all 0 none is.
    """
    labels = list(names)
    kind = f"struct<{','.join(f'frame_{n}:double' for n in labels)}>"

    @F.pandas_udf(kind)
    def run(parts: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        model = load()
        for s, _ in parts:
            rows = []
            for t in s:
                try:
                    x = model([t])[0] if t is not None else None
                except Exception:  # noqa: BLE001  the patterns stand in
                    x = None
                rows.append([None] * len(labels) if x is None else [x.get(n, 0.0) for n in labels])
            yield pd.DataFrame(rows, columns=[f"frame_{n}" for n in labels], dtype="float64")

    windows = text.variant_windows(F.col(body), variants, 5, MOST_WINDOWS)
    joined = F.when(F.size(windows) > 0, text.first_words(F.array_join(windows, " "), MOST_WORDS))
    rows = df.withColumn("_joined", joined).withColumn("_frames", run(F.col("_joined"), F.length("_joined")))
    by_model = F.col(f"_frames.frame_{labels[0]}").isNotNull()
    rows = rows.withColumns({f"frame_{n}": F.when(by_model, F.col(f"_frames.frame_{n}")).otherwise(text.frame_fraction(F.col(body), p)) for n, p in names.items()})
    columns = [f"frame_{n}" for n in labels]
    rows = rows.withColumn("dominant_frame", F.when(by_model, text.argmax(columns, False)).otherwise(text.argmax(columns)))
    return rows.withColumn("frame_method", F.when(by_model, "zeroshot").otherwise("keyword_fallback")).drop("_joined", "_frames")


EXTRACTED = "n_extractions int, extractions array<struct<extraction_class:string,extraction_text:string,attributes:map<string,string>>>, error string"


class RateLimited(RuntimeError):
    """The service refuses further calls (429)."""


def extract(df: DataFrame, load: Callable[[], Callable[[str], list[dict]]], key: str, texts: list[str], done: DataFrame | None = None, once: bool = True, carried: tuple[str, ...] = ()) -> DataFrame:
    """key, the carried columns and EXTRACTED for the rows not yet done: what a service finds in the first of the texts that is not blank.

    Rows without a text get the error empty_text, rows on which the service fails its message.  A task stops at RateLimited
    and leaves out that row and its later ones, so that they are pending in the next run.  Keys are taken once, unless once is
    false; they and the carried columns pass by the service as Arrow columns, as pandas makes whole numbers beside nulls floats.
    """
    rows = df.dropDuplicates([key]) if once else df
    if done is not None:
        rows = rows.join(done.select(key).distinct(), key, "left_anti")
    given = F.coalesce(*(F.when(F.trim(c) != "", F.col(c)) for c in texts))
    rows = rows.select(key, *carried, text.first_words(given, EXTRACT_WORDS).alias("_text"))

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        call = load()
        span = pa.struct({"extraction_class": pa.string(), "extraction_text": pa.string(), "attributes": pa.map_(pa.string(), pa.string())})
        listed = lambda x: x | {"attributes": list(m.items()) if (m := x.get("attributes")) is not None else None}
        for batch in parts:
            out, limited = [], False
            for t in batch.column("_text").to_pylist():
                found, error = [], None
                if t is None:
                    error = "empty_text"
                else:
                    try:
                        found = call(t)
                    except RateLimited:
                        limited = True
                        break
                    except Exception as e:  # noqa: BLE001  kept with the row
                        error = str(e)
                out.append((len(found), [listed(x) for x in found], error))
            own = [batch.column(c).slice(0, len(out)) for c in (key, *carried)]
            made = [pa.array([x[k] for x in out], kind) for k, kind in enumerate((pa.int32(), pa.list_(span), pa.string()))]
            yield pa.RecordBatch.from_arrays([*own, *made], [key, *carried, "n_extractions", "extractions", "error"])
            if limited:
                return

    own = ", ".join(f"{c} {rows.schema[c].dataType.simpleString()}" for c in (key, *carried))
    return rows.mapInArrow(run, f"{own}, {EXTRACTED}")


def note_flag(note: Column) -> Column:
    """Whether a coder's note says that the text is not about the entity."""
    return F.regexp_like(F.coalesce(note, F.lit("")), F.lit(f"(?i){patterns.NOT_RELEVANT}"))
