"""Configuration of the engine: entities, dictionaries, pattern banks and outcomes.

Nothing is wired to one corpus.  The defaults fit the generated test tables, whose prose is invented around function words.
"""

from __future__ import annotations

from dataclasses import dataclass, field


@dataclass(frozen=True)
class Entity:
    """A named entity with a validity interval (inclusive; end None: open)."""

    name: str
    region: str
    kind: str
    start: str
    end: str | None
    variants: tuple[str, ...]


@dataclass(frozen=True)
class Config:
    entities: tuple[Entity, ...] = (
        Entity("that", "north", "A", "2020-01-01", "2021-06-30", ("that",)),
        Entity("this", "north", "B", "2021-07-01", None, ("this",)),
        Entity("with", "south", "A", "2020-01-01", "2020-12-31", ("with",)),
        Entity("from", "south", "B", "2021-03-01", None, ("from",)),
        Entity("was", "west", "B", "2020-06-01", None, ("was", "were")),
    )
    #: Ordered: the first pattern that a publication contains names its region.
    publications: tuple[tuple[str, str], ...] = (("src1", "north"), ("src2", "south"), ("src3", "west"), ("src", "elsewhere"))
    keywords: tuple[str, ...] = ("the", "are", "license", "token", "stupid", "mit", "ing ", "on ", "public")
    themes: tuple[tuple[str, tuple[str, ...]], ...] = (
        ("license", ("licensed under", "general public", "license")),
        ("credential", ("token", "password")),
        ("insult", ("stupid", "idiot", "loser", "scum")),
        ("motion", ("to the", "from the", "into")),
    )
    negators: tuple[str, ...] = ("not", "no", "never", "without", "nicht", "pas")
    negating_phrases: tuple[str, ...] = ("far from",)
    frames: tuple[tuple[str, tuple[str, ...]], ...] = (
        ("legal", (r"\blicensed?\b", r"\bpublic\b", r"\bversion\b")),
        ("technical", (r"\btoken\b", r"\bsecret\b", r"\|")),
        ("narrative", (r"\bthat\b", r"\bwas\b", r"\bwith\b", r"\bhe\b")),
    )
    #: Method and weight of the composite score; a value below negative_below counts as negative.
    weights: dict[str, float] = field(default_factory=lambda: {"aspect": 0.35, "stance": 0.30, "keywords": 0.20, "document": 0.15})
    negative_below: float = -0.1
    #: Method and weight of the theme validation.
    theme_weights: dict[str, float] = field(default_factory=lambda: {"dict": 0.30, "regex": 0.35, "crit": 0.15, "cooc": 0.20})


DEFAULT = Config()
