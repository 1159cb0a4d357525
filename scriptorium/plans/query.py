"""The query language: text to OR groups of AND terms (Q1-Q4, F14). Driver side, plain Python."""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from ..functions import isri
from ..functions import text as T

# The separators of OR groups, quoted phrases, signs of exclusion.
OR = re.compile(r"\s*\|\s*|\s+(?:oder|or|أو)\s+", re.IGNORECASE)
PHRASE = re.compile(r'(-?)"([^"]+)"')
MINUS = ("-", "−")
_MARKS, _TOKEN = re.compile(T.MARKS), re.compile(T.TOKEN)
_FOLD = str.maketrans(T.FOLD_FROM, T.FOLD_TO)


def tokens(text: str) -> list[str]:
    return _TOKEN.findall(_MARKS.sub("", text).translate(_FOLD))


@dataclass(frozen=True)
class Term:
    norm: str
    stem: str


@dataclass
class Group:
    """All of include and phrases, none of exclude and neg_phrases. A phrase is words joined by blanks."""

    include: list[Term] = field(default_factory=list)
    exclude: list[Term] = field(default_factory=list)
    phrases: list[str] = field(default_factory=list)
    neg_phrases: list[str] = field(default_factory=list)

    @property
    def positive(self) -> bool:
        return bool(self.include or self.phrases)


def term(word: str) -> Term:
    return Term(word.lower(), isri.stem(word))


def parse(q: str) -> list[Group]:
    """OR groups split first; quoted phrases next; of other words the first token counts."""
    groups = []
    for part in OR.split(q.strip()):
        g = Group()
        for minus, phrase in PHRASE.findall(part):
            if words := tokens(phrase):
                (g.neg_phrases if minus else g.phrases).append(" ".join(words).lower())
        for word in PHRASE.sub(" ", part).split():
            if found := tokens(word.lstrip("".join(MINUS))):
                (g.exclude if word.startswith(MINUS) else g.include).append(term(found[0]))
        if g.positive or g.exclude or g.neg_phrases:
            groups.append(g)
    return groups


def structured(and_groups: list[list[str]], exclude: list[str] = ()) -> list[Group]:
    """OR of AND groups without syntax: a term of several tokens is a phrase; of an excluded one the first token counts."""
    out_terms = [term(t[0]) for t in map(tokens, exclude) if t]
    groups = []
    for names in and_groups:
        g = Group(exclude=list(out_terms))
        for found in filter(None, map(tokens, names)):
            if len(found) > 1:
                g.phrases.append(" ".join(found).lower())
            else:
                g.include.append(term(found[0]))
        if g.positive:
            groups.append(g)
    return groups


def is_boolean(groups: list[Group]) -> bool:
    return len(groups) > 1 or any(g.exclude or g.phrases or g.neg_phrases for g in groups)


def positive_stems(groups: list[Group]) -> list[str]:
    found = [t.stem for g in groups for t in g.include] + [isri.stem(w) for g in groups for p in g.phrases for w in p.split()]
    return list(dict.fromkeys(found))


def stems_of_terms(terms: list[str] | None) -> set[str]:
    return {isri.stem(w) for t in terms or [] for w in tokens(t or "")} - {""}
