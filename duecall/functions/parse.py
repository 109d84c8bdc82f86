"""Plain-language search: what a query asks for, as constraints and terms. Runs on the driver, over one short string."""

from __future__ import annotations

import re
import unicodedata
from dataclasses import dataclass, field
from datetime import datetime, timedelta

from duecall.functions.text import STOP_WORDS

# The words that the parser understands, and the concepts with their triggers and phrases.
NUMBERS = {"a": 1, "an": 1, "one": 1, "two": 2, "three": 3, "four": 4, "five": 5, "six": 6, "seven": 7, "eight": 8, "nine": 9, "ten": 10, "twelve": 12}
MONTHS = ["january", "february", "march", "april", "may", "june", "july", "august", "september", "october", "november", "december"]
FILLERS = [r"\b(?:deadline|deadlines|due|closing|closes|open|opportunities|opportunity|calls?|cfps?)\b", r"\b(?:my\s+work\s+is|research\s+is|researching|interested\s+in|related\s+to)\b"]
ROLLING = r"\brolling(?:\s+deadline|\s+calls?|\s+submissions?)?\b"
TRUSTED = r"\b(?:trusted|verified|legitimate)\s+(?:only|calls?|venues?|conferences?|journals?|publishers?)\b|\bonly\s+(?:trusted|verified|legitimate)\b"
TYPES = [
    (["reviewer-call"], r"\b(?:call(?:s)?\s+for\s+reviewers?|reviewer\s+(?:calls?|opportunities|applications?)|review\s+papers?)\b"),
    (["special-issue"], r"\bspecial\s+issues?\b"),
    (["book-proposal"], r"\b(?:book|monograph)\s+proposals?\b|\bbooks?\b"),
    (["chapter-proposal"], r"\bchapter\s+proposals?\b|\bchapters?\b"),
    (["workshop-proposal"], r"\b(?:host|organize|organise|propose)\s+(?:a\s+)?workshops?\b|\bworkshop\s+proposals?\b"),
    (["workshop"], r"\bworkshops?\b"),
    (["journal", "special-issue"], r"\bjournals?\b"),
    (["conference"], r"\bconferences?\b|\bvenues?\b"),
]
CONCEPTS = {
    "trustworthy AI": (
        ["trustworthy ai", "responsible ai", "ethical ai", "ai safety"],
        ["trustworthy ai", "responsible ai", "ai safety", "explainable ai", "artificial intelligence ethics", "algorithmic fairness", "machine learning fairness", "robust machine learning", "ai accountability", "ai transparency", "ai governance", "privacy preserving machine learning", "xai"],
    ),
    "machine learning": (["machine learning", "ml"], ["machine learning", "deep learning", "neural networks", "representation learning", "foundation models"]),
    "natural language processing": (["natural language processing", "nlp", "language models", "llm", "llms"], ["natural language processing", "computational linguistics", "language model", "large language model", "text mining", "nlp"]),
    "computer vision": (["computer vision", "vision", "image understanding"], ["computer vision", "image processing", "medical imaging", "visual recognition", "multimodal learning"]),
    "data science": (["data science", "data mining", "analytics"], ["data science", "data mining", "knowledge discovery", "data analytics", "big data", "database systems"]),
    "cybersecurity": (["cybersecurity", "cyber security", "information security", "privacy"], ["cybersecurity", "computer security", "information security", "privacy", "cryptography", "secure systems"]),
    "human-computer interaction": (["human computer interaction", "hci", "human ai interaction"], ["human computer interaction", "human ai interaction", "user experience", "interactive systems", "social computing", "hci"]),
    "AI for health": (["ai for health", "health ai", "medical ai", "clinical ai"], ["health ai", "medical ai", "clinical ai", "biomedical informatics", "medical imaging", "digital health", "healthcare"]),
}
AT_LEAST = ["at least", "minimum of", "more than", "no sooner than"]
AT_MOST = ["within", "in the next", "in less than", "less than", "under", "no more than"]
AFTER = ["after", "later than", "no earlier than"]
BEFORE = ["before", "earlier than", "no later than"]


def _spoken(words: list[str]) -> str:
    return "|".join(w.replace(" ", r"\s+") for w in words)


_AMOUNT = rf"(?P<n>\d+|{'|'.join(NUMBERS)})\s+(?P<unit>day|week|month|year)s?"
_DATE = rf"(?P<month>{'|'.join(f'{m[:3]}(?:{m[3:]})?' for m in MONTHS)})\s+(?P<day>\d{{1,2}})(?:\s+(?P<year>\d{{4}}))?"
_LEAST = re.compile(rf"\b(?:{_spoken(AT_LEAST)})\s+{_AMOUNT}(?:\s+(?:away|from\s+now))?")
_MOST = re.compile(rf"\b(?P<how>{_spoken(AT_MOST)})\s+(?:the\s+next\s+)?{_AMOUNT}")
_AFTER = re.compile(rf"(?:deadline\s+)?(?:{_spoken(AFTER)})\s+{_DATE}")
_BEFORE = re.compile(rf"(?:deadline\s+)?(?:{_spoken(BEFORE)})\s+{_DATE}")


@dataclass
class Search:
    raw: str
    normalized: str
    text: str = ""
    terms: list[str] = field(default_factory=list)
    concepts: dict[str, list[str]] = field(default_factory=dict)
    types: list[str] = field(default_factory=list)
    least: datetime | None = None
    most: datetime | None = None
    before: datetime | None = None
    strict: bool = False
    rolling: bool = False
    trusted: bool = False


def normal(text: str) -> str:
    low = "".join(c for c in unicodedata.normalize("NFKD", text) if not "̀" <= c <= "ͯ").lower()
    return " ".join(re.sub(r"[^a-z0-9+#./-]+", " ", low).split())


def words(text: str) -> list[str]:
    """The words of a normal text that carry meaning."""
    found = (w.strip("./-") for w in text.split())
    return [w for w in found if w and w not in STOP_WORDS and (len(w) > 1 or w.isdigit())]


def shifted(now: datetime, n: int, unit: str) -> datetime:
    """now and so many units; days that a month lacks run on into the next one."""
    if unit in ("day", "week"):
        return now + timedelta(days=n * (7 if unit == "week" else 1))
    month = now.month - 1 + n * (12 if unit == "year" else 1)
    return now.replace(year=now.year + month // 12, month=month % 12 + 1, day=1) + timedelta(days=now.day - 1)


def named_date(found: re.Match, now: datetime) -> datetime | None:
    """The day that a match of _DATE names: this year's, or next year's if that is over; none for a day that no month has."""
    month = next(k for k, m in enumerate(MONTHS, 1) if m.startswith(found["month"][:3]))
    if not 1 <= int(found["day"]) <= 31:
        return None
    of = lambda year: datetime(year, month, 1) + timedelta(days=int(found["day"]) - 1)
    when = of(int(found["year"] or now.year))
    return when if found["year"] or when >= now else of(now.year + 1)


def parse(raw: str, now: datetime) -> Search:
    """Constraints, concepts and leftover terms of a query; named dates override durations."""
    text = re.sub(r"\batleast\b", "at least", normal(raw))
    out = Search(raw, text)
    rest = text
    without = lambda m: rest.replace(m[0], " ", 1)
    amount = lambda m: (NUMBERS.get(m["n"]) or int(m["n"]) or 1, m["unit"])
    if m := _LEAST.search(text):
        out.least, rest = shifted(now, *amount(m)), without(m)
    if m := _MOST.search(text):
        when, rest = shifted(now, *amount(m)), without(m)
        out.strict = m["how"].endswith("than") and "more" not in m["how"] or m["how"] == "under"
        out.before, out.most = (when, None) if out.strict else (None, when)
    if m := _AFTER.search(text):
        out.least, rest = named_date(m, now), without(m)
    if m := _BEFORE.search(text):
        out.most, out.before, rest = named_date(m, now), None, without(m)
    out.rolling, rest = bool(re.search(ROLLING, text)), re.sub(ROLLING, " ", rest)
    out.trusted, rest = bool(re.search(TRUSTED, text)), re.sub(TRUSTED, " ", rest)
    for kinds, pattern in TYPES:
        if re.search(pattern, text) and not ("workshop" in kinds and "workshop-proposal" in out.types):
            out.types += [k for k in kinds if k not in out.types]
            rest = re.sub(pattern, " ", rest, count=1)
    for filler in FILLERS:
        rest = re.sub(filler, " ", rest)
    found = words(rest)
    out.text, out.terms = " ".join(found), list(dict.fromkeys(found))
    out.concepts = {name: phrases for name, (triggers, phrases) in CONCEPTS.items() if any(t in text for t in triggers)}
    return out


def day(when: datetime) -> str:
    return f"{when:%b} {when.day}, {when.year}"


def described(s: Search) -> str:
    """What was understood, in words."""
    last = s.most or s.before
    if s.before:  # the last moment before it
        last = s.before - timedelta(milliseconds=1)
    parts = [
        f"topic: {s.text}" if s.text else "",
        f"type: {' or '.join(s.types).replace('-', ' ')}" if s.types else "",
        f"deadline on/after {day(s.least)}" if s.least else "",
        f"deadline {'before' if s.strict else 'on/before'} {day(last)}" if last else "",
        "rolling calls only" if s.rolling else "",
        "trusted only" if s.trusted else "",
    ]
    return " · ".join(p for p in parts if p)
