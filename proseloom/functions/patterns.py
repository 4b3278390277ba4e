"""The patterns, word lists and phrases that decide results, and the options with their defaults."""

from __future__ import annotations

import json
import os
import re
from dataclasses import dataclass, field, replace

# Patterns, as Java regular expressions ((?U): Unicode classes and word bounds, (?i): case-insensitive).
NUMBER = r"(?U)\d|%|\$"
DATE = r"(?Ui)\b(19|20)\d{2}\b|\b(january|february|april|june|july|september|october|november|december)\b"
CAUSAL = r"(?Ui)\b(cause[sd]?|reduce[sd]?|increase[sd]?|decrease[sd]?|improve[sd]?|lead(s|ing)? to|result(s|ed|ing)? in|due to|because)\b"
COMPARATIVE = r"(?Ui)\b(more|less|fewer|faster|slower|better|worse|best|worst|most|least|greater|higher|lower|\w+er than)\b"
APPEAL = r"(?Ui)\b(studies show|study shows|research (suggests|shows)|experts? say|scientists? (say|found)|according to)\b"
LINK = r"(?Ui)\]\([^)]*\)|https?://"
FOOTNOTE = r"(?U)\[\^[^\]]+\]"
INLINE_CITE = r"(?U)\([^)]*\b(19|20)\d{2}\)|\[\d+\]"
AUTHORITY = r"(?Ui)\b(WHO|CDC|NIH|FDA|NASA|OECD|a study|the study|published in|et al\.?)\b"
VAGUE = r"(?![^.]{0,24}\b(?:experts?|studies|research|scientists?|sources?|analysts?|literature)\b)"
ATTRIBUTION = (
    r"(?Ui)\b(?:according to|as per|per|measured by|recorded by|reported by|taken from|sourced from|drawn from|as (?:\w+ ){0,3}?"
    r"(?:recorded|reported|measured|logged|captured|documented|published|listed|described|written|set out|shown)(?: (?:in|by|on|at))?)"
    r"\s+(?:the|our|its|their|this|that|these|those|my|his|her)\b" + VAGUE
)
WITNESS = (
    r"(?Ui)\bas (?:the|our|its|their|this|that)\b" + VAGUE + r"[^.,;]{0,60}? (?:shows?|showed|records?|recorded|indicates?|indicated|"
    r"says?|said|reports?|reported|confirms?|confirmed)\b"
)
LOCATION = (
    r"(?Ui)\b(?:links?|figures?|numbers?|data|records?|exports?|logs?|dashboards?|readings?|measurements?|breakdowns?|screenshots?|"
    r"transcripts?|evidence)\b[^.]{0,30}?\b(?:is|are|lives?|sits?|can be found|is available|are available)\s+(?:in|on|at|under)\s+"
    r"(?:the|our|its|their|this|that)\b"
)
CLOCK = r"(?U)\b\d{1,2}:\d{2}(?::\d{2})?\b"
PROPER_NOUN = r"^[A-Z][a-z]+"
URL = r"(?Ui)https?://[^\s<>()\[\]\"']+"
DOI = r"(?Ui)(?:https?://(?:dx\.)?doi\.org/|\bdoi:\s*)?(10\.\d{4,}(?:\.\d+)*/[^\s\"<>]+)"

# The word lists.
STOPWORDS = (
    "the a an and or but of to in on for with as at by be is are was were been it its this that these those from into we you they he "
    "she our your their his her them us me can will would should could may might must do does did has have had not no so if then than "
    "too very just also about there here when"
).split()
ABBREVIATIONS = "dr mr mrs ms prof sr jr st vs etc no fig al inc ltd co cf".split()
SUFFIXES = ["ing", "ed", "es", "s"]
FILLER = [
    "it is important to note",
    "in today's world",
    "at the end of the day",
    "when it comes to",
    "needless to say",
    "it goes without saying",
    "the fact of the matter is",
    "in the world of",
]
PRIVATE_SUFFIXES = [".local", ".localhost", ".internal", ".intranet", ".lan", ".home.arpa"]
#: Digits, letters and dots that some readers of URLs take for plain ones; percent signs.
DISGUISED = r"%|[\uff01-\uff5e\u3002\uff61]|[\p{Nd}&&[^0-9]]"
#: Characters that no host's name has: neither letters, digits, marks, -, _ and dots nor those of DISGUISED.
NO_NAME = r"[^\p{L}\p{M}\p{N}._%\uff01-\uff5e\u3002\uff61-]"
RULES = ["GROUND001", "DENSITY001", "FILLER001"]

# Block pieces: every character of a text belongs to one match, a block after the blank lines before it, or white space at
# the end; groups that repeat are possessive (no deep recursion).
_W = r"[^\S\n]*+"
_START = _W + r"(?:```|~~~|#{1,6}(?: |\r?(?:\n|\z))|>|[-*+] |\d++[.)] )"
_FENCES = "|".join(f + r"[^\n]*+(?:\n(?!" + _W + f + r")[^\n]*+)*+(?:\n[^\n]*+)?+" for f in ("```", "~~~"))
PIECES = (
    "(?U)(?:" + _W + r"\n)*+(?:" + _W + "(?:" + _FENCES + r"|#{1,6}(?: [^\n]*+|(?=\r?(?:\n|\z)))|>[^\n]*+(?:\n" + _W + r">[^\n]*+)*+|(?:[-*+] |\d++[.)] )[^\n]*+)"
    + "|(?!" + _START + r")[^\n]*\S[^\n]*+(?:\n(?!" + _START + r")[^\n]*\S[^\n]*+)*+)" + r"|\s++"
)
# A sentence runs over white space, abbreviations and dotted acronyms that are the start of a token, other characters, and
# marks that aren't followed by a capital letter or the end; then comes the mark that is. All repeats are possessive, so
# each character is read once and no run is too long.
_ACRONYM = r"(?<!\S)(?=[a-zA-Z]{1,4}+\.)(?:(?:[a-zA-Z]\.)++|(?i:" + "|".join(ABBREVIATIONS) + r")\.)"
SENTENCES = r"(?sU)(?=.)(?:\s++|" + _ACRONYM + r"|[^.!?\s]++|[.!?](?!\s*(?:\p{Lu}|\z)))*+[.!?]?"
#: White space as (?U)\s has it.
SPACE = "\t\n\x0b\x0c\r \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"


def for_ascii(pattern: str) -> str:
    """The pattern as it reads texts of ASCII, on which it matches the same: Unicode classes and word bounds take many
    times as long as plain ones."""
    flags, rest = pattern.removeprefix("(?").split(")", 1) if pattern.startswith("(?") and "U" in pattern[: pattern.index(")")] else ("", pattern)
    flags = flags.replace("U", "")
    return (f"(?{flags})" if flags else "") + rest.replace(r"\p{Lu}", "[A-Z]")


def any_of(*patterns: str) -> str:
    """One pattern for texts that any of the patterns, all of the flags (?Ui), is found in."""
    return "(?Ui)" + "|".join(f"(?:{p.removeprefix('(?Ui)')})" for p in patterns)


def phrase_pattern(phrases: list[str]) -> str:
    """A pattern that matches the longest of the phrases at each place they start at, as a group of a zero-width match: one
    pass finds them all, overlapping ones too. Phrases that start alike share that start, so a place is left at the first
    character that none of them has."""

    escaped = lambda text: re.sub(r"([^\w\s])", r"\\\1", text)

    def either(ways: list[tuple[str, str]]) -> str:
        """Ways by their first characters, halved by a look at the next character until few are left to try."""
        if len(ways) <= 8:
            return "|".join(way for _, way in ways)
        half = len(ways) // 2
        return f"(?=[{''.join(escaped(c) for c, _ in ways[:half])}])(?:{either(ways[:half])})|{either(ways[half:])}"

    def alike(some: list[str], at: int) -> str:
        """What may follow when the first ``at`` characters, which all share, have been read; the list is sorted."""
        own = "?+" if len(some[0]) == at else ""
        rest, ways = some[1:] if own else some, []
        while rest:
            same = [p for p in rest if p[at] == rest[0][at]]
            end = len(os.path.commonprefix([same[0], same[-1]]))
            ways.append((rest[0][at], escaped(same[0][at:end]) + alike(same, end)))
            rest = rest[len(same) :]
        return ("(?:" + either(ways) + ")" + own if own or len(ways) > 1 else ways[0][1]) if ways else ""

    return f"(?=({alike(sorted({p for p in phrases if p}), 0)}))"


@dataclass(frozen=True)
class Options:
    """Thresholds and lexicon. The fields may be Columns too (`options_of`)."""

    grounding_weight: float = 0.6
    density_weight: float = 0.4
    watch_at: float = 0.2
    slop_at: float = 0.5
    high_overlap: float = 0.5
    low_novelty: float = 0.35
    min_filler_hits: int = 2
    min_claims: int = 3
    filler: list[str] = field(default_factory=lambda: list(FILLER))

    @staticmethod
    def from_json(text: str) -> Options:
        """Missing fields keep their defaults; filler extends the list, lower-cased; JSON null is all defaults; names in
        any case; malformed JSON raises ValueError."""
        raw = json.loads(text)
        if raw is None:
            return Options()
        if not isinstance(raw, dict):
            raise ValueError("options must be a JSON object")

        def low(x):
            return {k.lower(): low(v) for k, v in x.items()} if isinstance(x, dict) else x

        raw, given = low(raw), {}
        names = {
            "weights": {"grounding": "grounding_weight", "density": "density_weight"},
            "bands": {"watch": "watch_at", "slop": "slop_at"},
            "density": {"highoverlap": "high_overlap", "lownovelty": "low_novelty", "minfillerhits": "min_filler_hits"},
            "grounding": {"minclaims": "min_claims"},
        }
        for group, fields in names.items():
            for name, target in fields.items():
                if (value := (raw.get(group) or {}).get(name)) is not None:
                    given[target] = value
        return replace(Options(), **given, filler=FILLER + [p.lower() for p in raw.get("filler") or []])
