"""Pattern banks: templates with an entity placeholder, fallbacks, co-occurrence and provenance."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import text

PLACEHOLDER = "_P"
#: How notes say that a text is of little relevance, or about somebody else.
NOT_RELEVANT = r"low\s*\w*\s*relevan|non-?prosecutor|not\s+(?:about|mainly|only|primarily)|mainly\s+about|wrong\s+(?:da|prosecutor|target)|refers?\s+to\s+another"


def expand(templates, variants) -> list[str]:
    """Regexes of templates for one entity: the placeholder becomes the alternation of its variants, longest first."""
    names = "(?:" + "|".join(re.escape(v) for v in sorted(variants, key=lambda v: (-len(v), v))) + ")"
    return [t.replace(PLACEHOLDER, names) for t in templates]


def hits(t: Column, patterns) -> Column:
    """How many patterns of a bank a text matches, case-insensitively."""
    return sum((F.regexp_like(F.coalesce(t, F.lit("")), F.lit(f"(?i){p}")).cast("long") for p in patterns), F.lit(0).cast("long"))


def with_fallback(named: Column, generic: Column) -> Column:
    """Windows of named mentions, or those of generic references where there is none."""
    return F.when(F.size(named) > 0, named).otherwise(generic)


def cooccurrence(t: Column, entity: str, terms: str) -> Column:
    """Matches of terms in sentences that mention the entity."""
    held = F.filter(text.sentences(t), lambda s: F.regexp_like(F.lower(s), F.lit(entity)))
    return F.aggregate(held, F.lit(0).cast("long"), lambda a, s: a + F.regexp_count(F.lower(s), F.lit(terms)))


def vetoed(t: Column, surname: str, first: str, titles=("da", "mr", "ms", "district attorney")) -> Column:
    """Whether a surname alone is not evidence: no first name anywhere, and no title right before the surname."""
    low = F.lower(F.coalesce(t, F.lit("")))
    title = "|".join(re.escape(x) for x in titles)
    return F.contains(low, F.lit(surname.lower())) & ~F.contains(low, F.lit(first.lower())) & ~F.regexp_like(low, F.lit(rf"\b(?:{title})\.? {re.escape(surname.lower())}\b"))


def provenance(candidates: dict[str, Column]) -> tuple[Column, Column]:
    """First value that is not null, and the name of its source ('none' without one)."""
    source = None
    for name, c in candidates.items():
        source = F.when(c.isNotNull(), name) if source is None else source.when(c.isNotNull(), name)
    return F.coalesce(*candidates.values()), source.otherwise("none")


def numbered_items(t: Column) -> Column:
    """(n, class, text) of lines 'n. [class] text'."""
    lines = F.filter(F.split(t, "\n"), lambda x: F.regexp_like(x, F.lit(r"^\d+\. \[[^\]]*\]")))
    part = lambda x, k: F.regexp_extract(x, r"^(\d+)\. \[([^\]]*)\]\s*(.*)$", k)
    return F.transform(lines, lambda x: F.struct(part(x, 1).cast("int").alias("n"), part(x, 2).alias("class"), part(x, 3).alias("text")))


def relabel(c: Column, names: dict[str, str]) -> Column:
    """Known labels by their synonyms' names, others as they are."""
    return F.coalesce(F.element_at(F.create_map(*(F.lit(x) for kv in names.items() for x in kv)), c), c)
