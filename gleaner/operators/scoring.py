"""Attribution and composite scores."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Protocol

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import Config
from ..functions import scalars, text


def mention_array(df: DataFrame, config: Config, body: str, headline: str) -> DataFrame:
    """mentions: array of (entity, body_n, headline_n, ord) in declared order.  The entities are unrolled at plan time, so no
    join and no shuffle is needed; explode it for the long form."""
    parts = [F.struct(F.lit(e.name).alias("entity"), text.mentions(F.col(body), e.variants).alias("body_n"), text.mentions(F.col(headline), e.variants).alias("headline_n"), F.lit(k).alias("ord")) for k, e in enumerate(config.entities)]
    return df.withColumn("mentions", F.array(*parts))


def primary_entity(mentions: Column, veto: Column | None = None) -> Column:
    """Entity of the highest body + 3 * headline count, ties to declared order; null if none is mentioned."""
    scored = F.transform(mentions, lambda m: F.struct((m["body_n"] + 3 * m["headline_n"]).alias("s"), (-m["ord"]).alias("o"), m["entity"].alias("e")))
    best = F.array_max(F.filter(scored, lambda x: (x["s"] > 0) if veto is None else (x["s"] > 0) & ~F.array_contains(veto, x["e"])))
    return best["e"]


def relevant(mentions: Column, entity: Column) -> Column:
    """Two body mentions, or one in the headline, of the own entity."""
    return F.exists(mentions, lambda m: (m["entity"] == entity) & ((m["body_n"] >= 2) | (m["headline_n"] >= 1)))


def dominant(mentions: Column, entity: Column, others: Column) -> Column:
    """relevant(), and more own mentions than all others (of other entities, and untracked)."""
    own = F.aggregate(mentions, F.lit(0).cast("long"), lambda a, m: a + F.when(m["entity"] == entity, m["body_n"]).otherwise(0))
    total = F.aggregate(mentions, F.lit(0).cast("long"), lambda a, m: a + m["body_n"])
    return relevant(mentions, entity) & (own > total - own + others)


def theme_flags(col: Column, config: Config) -> dict[str, Column]:
    low = F.lower(F.coalesce(col, F.lit("")))
    out = {}
    for name, phrases in config.themes:
        hit = F.lit(False)
        for p in phrases:
            hit = hit | F.contains(low, F.lit(p))
        out[name] = hit
    return out


def keyword_component(flags: dict[str, Column]) -> Column:
    return -sum((f.cast("double") for f in flags.values()), F.lit(0.0)) / len(flags)


def composite(values: dict[str, Column], config: Config) -> tuple[Column, Column]:
    """Null-renormalised weighted mean, and the number of methods below the threshold."""
    negative = sum((F.coalesce((v < config.negative_below).cast("int"), F.lit(0)) for v in values.values()), F.lit(0))
    return scalars.weighted_mean(values, config.weights), negative.cast("long")


def method_score(hits: Column) -> Column:
    return F.least(5.0 * hits, F.lit(25.0))


def validate_themes(scores: dict[str, Column], config: Config) -> tuple[Column, Column, Column]:
    """Score, methods and confidence: weighted sum; below two methods at most 15, for two times 1.1, for more times 1.25; at
    most 100; half-even to two places."""
    base = sum((scores[k] * w for k, w in config.theme_weights.items()), F.lit(0.0))
    n = sum(((s > 0).cast("int") for s in scores.values()), F.lit(0))
    raw = F.when(n < 2, F.least(base, F.lit(15.0))).when(n == 2, base * 1.1).otherwise(base * 1.25)
    return F.bround(F.least(raw, F.lit(100.0)), 2), n.cast("long"), F.when(n >= 3, "High").when(n == 2, "Medium").otherwise("Low")


def indicator_score(anti: Column, pro: Column, most: int = 5) -> Column:
    """The larger of two saturating signals, negative for anti; ties 0."""
    a, p = F.least(anti, F.lit(most)) / most, F.least(pro, F.lit(most)) / most
    return F.when(a > p, -a).when(p > a, p).otherwise(F.lit(0.0))


#: Attribute that says which way loaded wording leans: its values, and what a missing or unknown one counts as.
VALENCES, DEFAULT_VALENCE = ("favorable", "unfavorable"), "unfavorable"
#: Counts of an article's extractions by class and folded attributes.
INDICATORS = {
    "n_total": "class is not null",
    "n_claims": "class = 'claim'",
    "n_claims_severe": "class = 'claim' and evidence in ('none', 'anonymous_source')",
    "n_blame": "class = 'claim' and blame = 'true'",
    "n_critical": "class = 'imbalance' and stance = 'critical'",
    "n_supportive": "class = 'imbalance' and stance = 'supportive'",
    "n_loaded": "class = 'loaded'",
    "n_loaded_negative": "class = 'loaded' and target in ('entity', 'policy') and leaning = 'unfavorable'",
    "n_loaded_favorable": "class = 'loaded' and target in ('entity', 'policy') and leaning = 'favorable'",
    "n_missing_context": "class = 'missing_context'",
}
ATTRIBUTES = ("evidence", "blame", "stance", "target", "valence")


def flat_extractions(df: DataFrame, key: str, extractions: str) -> DataFrame:
    """key, class, the folded ATTRIBUTES and leaning (valence, or its default) of every extraction; one empty row without any."""
    e = df.select(key, F.explode_outer(extractions).alias("_e"))
    rows = e.select(key, F.col("_e.class").alias("class"), *(text.fold_attribute(F.element_at("_e.attributes", a)).alias(a) for a in ATTRIBUTES))
    return rows.withColumn("leaning", F.when(F.col("valence").isin(*VALENCES), F.col("valence")).otherwise(DEFAULT_VALENCE))


def indicator_counts(flat: DataFrame, key: str) -> DataFrame:
    """key and INDICATORS, from flat_extractions()."""
    return flat.groupBy(key).agg(*(F.count_if(F.expr(f"coalesce({rule}, false)")).alias(name) for name, rule in INDICATORS.items()))


def quality_counters(flat: DataFrame) -> DataFrame:
    """reason and n of extractions whose attributes are missing or unknown."""
    reason = (
        F.when((F.col("class") == "loaded") & (F.coalesce("valence", F.lit("")) == ""), "legacy_no_valence")
        .when((F.col("class") == "loaded") & ~F.col("valence").isin(*VALENCES), F.concat(F.lit("unmapped_valence_"), "valence"))
        .when((F.col("class") == "imbalance") & ~F.coalesce(F.col("stance").isin("critical", "supportive"), F.lit(False)), F.concat(F.lit("unmapped_stance_"), F.coalesce(F.nullif("stance", F.lit("")), F.lit("missing"))))
    )
    return flat.select(reason.alias("reason")).where("reason is not null").groupBy("reason").agg(F.count("*").alias("n"))


class Scorer(Protocol):
    """A model: scores of a batch of texts.  It may raise; the batch's scores are then null."""

    def __call__(self, texts: list[str]) -> list[float]: ...


def lexical_scorer(positive: tuple[str, ...], negative: tuple[str, ...]) -> Callable[[list[str]], list[float]]:
    """A deterministic stand-in for a model: (p - n) / (p + n) over words."""

    def score(texts: list[str]) -> list[float]:
        out = []
        for t in texts:
            words = t.lower().split()
            p, n = sum(w in positive for w in words), sum(w in negative for w in words)
            out.append((p - n) / (p + n) if p + n else 0.0)
        return out

    return score


def apply_model(df: DataFrame, load: Callable[[], Scorer], column: str, out: str, batch: int = 16) -> DataFrame:
    """Scores of a text column in batches; load() runs once a task, a failing batch gives null."""

    @F.pandas_udf("double")
    def run(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = load()
        for s in parts:
            values: list[float | None] = []
            for k in range(0, len(s), batch):
                texts = [x or "" for x in s.iloc[k : k + batch]]
                try:
                    values += model(texts)
                except Exception:  # noqa: BLE001  a model's failure is a missing score
                    values += [None] * len(texts)
            yield pd.Series(values, dtype="float64")

    return df.withColumn(out, run(F.col(column)))


def mean_over_windows(df: DataFrame, load: Callable[[], Scorer], key: str, windows: str, out: str) -> DataFrame:
    """key and the mean score of an array of texts; rows without any have none."""
    parts = df.select(key, F.explode(windows).alias("_w"))
    return apply_model(parts, load, "_w", "_s").groupBy(key).agg(F.avg("_s").alias(out))
