"""Secrets: base patterns, and multipart credentials whose weak parts count only together.

Base spans are reported by themselves. Beyond them three roles are collected: identifiers of an access, secrets and
endpoints, each from patterns too weak to report alone. Scopes are paragraphs (text between blank lines). Within a scope
the intervals of ``REACH`` characters around the parts are joined with the parts of the other roles by binary search
over their sorted ends: a weak identifier or a weak secret is reported if its complement lies within reach, an endpoint
if it reaches a secret and an identifier. Base spans serve as parts. Nothing is capped; the join never lists pairs.

Defined results: a null or empty text has no spans; a weak span that overlaps a base span is left out; repeated rows
give repeated rows; an empty table gives an empty table; extra columns pass through, one named ``spans`` is replaced.
"""

from __future__ import annotations

import re

import numpy as np
from pyspark.sql import DataFrame

from assayframe.llm.spans import Span, Taken, with_spans

BASE = ["assign", "access", "hex"]
WEAK = ["weak_id", "weak_secret", "endpoint"]
KINDS = BASE + WEAK
#: Characters within which complementary parts count as one credential.
REACH = 200

_ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
_WORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]{32,}")
_SCOPE = re.compile(r"\n[ \t\r]*\n")

_WEAK_ID = re.compile(
    r"""(?<![A-Za-z0-9])(?:(?:ASIA|AIDA|AROA|AGPA)[A-Z0-9]{12,}|(?:access[_-]?key(?:[_-]?id)?|client[_-]?id|account|user(?:name)?|login)["']?\x20*[:=]\x20*["']?[A-Za-z0-9+/_.@=-]{3,})""",
    re.I | re.A)
_WEAK_SECRET = re.compile(
    r"""(?<![A-Za-z0-9+/_-])(?:gh[pousr]_[A-Za-z0-9]{20,}|(?:pwd|pass|passphrase|credential|auth)["']?\x20*[:=]\x20*["']?[A-Za-z0-9+/_.=-]{6,}|[A-Za-z0-9+/_-]{24,}={0,2})(?![A-Za-z0-9+/_-])""",
    re.A)
_ENDPOINT = re.compile(r"""(?:https?|s3|jdbc:[a-z]+|postgres(?:ql)?|mysql|mongodb|redis|amqp|ftp)://[^\s"'<>]+|(?<![\w.-])(?:[a-z0-9-]+\.)+(?:amazonaws\.com|windows\.net|googleapis\.com)(?![\w-])""", re.A)


def base_spans(text: str) -> list[Span]:
    """Leftmost matches of each kind that do not overlap; those that fail a condition are dropped."""
    found: list[Span] = []
    lower = text.lower()
    if any(word in lower for word in _WORDS):
        found += [("assign", *m.span(), True) for m in _ASSIGN.finditer(text) if len(m[2]) >= 8]
    if "AKIA" in text:
        found += [("access", *m.span(), True) for m in _ACCESS.finditer(text) if m.end() - m.start() >= 16]
    found += [("hex", *m.span(), True) for m in _HEX.finditer(text)]
    return found


def random_looking(word: str) -> bool:
    """Digits and letters in both cases, and many different characters."""
    body = word.rstrip("=")
    return any(c.isdigit() for c in body) and any(c.islower() for c in body) and any(c.isupper() for c in body) and len(set(body)) >= 12


def weak_parts(text: str) -> dict[str, list[tuple[int, int]]]:
    return {
        "weak_id": [m.span() for m in _WEAK_ID.finditer(text)],
        "weak_secret": [m.span() for m in _WEAK_SECRET.finditer(text) if "=" in m[0][:12] or ":" in m[0][:12] or m[0][:2] == "gh" or random_looking(m[0])],
        "endpoint": [m.span() for m in _ENDPOINT.finditer(text)],
    }


def reaches(parts: np.ndarray, others: np.ndarray, scopes: np.ndarray, reach: int = REACH) -> np.ndarray:
    """For each of ``parts`` (rows of start and end): whether one of ``others`` lies within ``reach`` in the same scope.

    ``scopes`` are the sorted first positions of the scopes. An interval join by binary search: the first of the others
    that ends after the widened part begins must begin before it ends.
    """
    if not len(parts) or not len(others):
        return np.zeros(len(parts), bool)
    others = others[np.argsort(others[:, 0], kind="stable")]
    scope = np.searchsorted(scopes, parts[:, 0], "right") - 1
    low = np.maximum(parts[:, 0] - reach, scopes[scope])
    high = np.minimum(parts[:, 1] + reach, np.append(scopes[1:], np.iinfo(np.int64).max)[scope])
    first = np.searchsorted(np.maximum.accumulate(others[:, 1]), low, "right")
    return (first < len(others)) & (others[np.minimum(first, len(others) - 1), 0] < high)


def linked_spans(text: str, base: list[Span]) -> list[Span]:
    """The weak spans of a text whose complementary parts lie within reach."""
    parts = weak_parts(text)
    table = lambda spans: np.array(sorted(spans), np.int64).reshape(-1, 2)
    strong_id = [(s, e) for kind, s, e, _ in base if kind == "access"]
    strong_secret = [(s, e) for kind, s, e, _ in base if kind != "access"]
    taken = Taken(strong_id + strong_secret)
    free = {kind: [p for p in spans if not taken.overlaps(*p)] for kind, spans in parts.items()}
    ids, secrets = table(strong_id + free["weak_id"]), table(strong_secret + free["weak_secret"])
    scopes = np.array([0, *(m.end() for m in _SCOPE.finditer(text))], np.int64)
    complements = {"weak_id": [secrets], "weak_secret": [ids], "endpoint": [secrets, ids]}
    found: list[Span] = []
    for kind, needs in complements.items():
        own = table(free[kind])
        hit = np.logical_and.reduce([reaches(own, other, scopes) for other in needs])
        found += [(kind, int(s), int(e), False) for s, e in own[hit]]
    return found


#: What a text must hold for any identifier; without one nothing can be linked.
_ANY_ID = re.compile(r"AKIA|ASIA|AIDA|AROA|AGPA|access[_-]?key|client[_-]?id|account|user|login", re.I | re.A)


def find(texts: list[str]) -> list[list[Span]]:
    found = []
    for text in texts:
        spans = base_spans(text)
        if _ANY_ID.search(text):
            spans += linked_spans(text, spans)
        found.append(spans)
    return found


def secrets(docs: DataFrame, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """``docs`` (or its columns ``keep``) with ``spans`` of all secrets in the whole texts."""
    return with_spans(docs, find, KINDS, text, keep)
