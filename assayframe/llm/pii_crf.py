"""Personal data: base patterns with checks, and a linear-chain conditional random field for what they miss.

The field labels the words of a text with the beginning or inside of a kind. Its features are word shapes (digits as
``9``, letters as ``a`` or ``A``, runs shortened), digit counts and cue words of a word and its neighbours. It is trained
on the small labelled table in ``labelled_lines``, all lines at once by forward and backward sums, and decoded by
Viterbi in numpy over a batch of word sequences together.

Only words near a digit or an at sign (``@``, ``(at)``, ``[at]``) can get a label: a plain word scores best outside by a margin no transition makes
up (``plain_margin``, checked after training), so a path that leaves the windows around such words is never the best.
Every such word of every text is decoded.

Defined results: a null or empty text has no spans; a span of the field that overlaps a base span is left out; repeated
rows give repeated rows; an empty table gives an empty table; extra columns pass through, one named ``spans`` is
replaced; texts of any length are scanned in linear time.
"""

from __future__ import annotations

import functools
import re

import numpy as np
from pyspark.sql import DataFrame

from assayframe.llm.labelled_lines import LINES
from assayframe.llm.spans import Span, Taken, with_spans

KINDS = ["email", "ip", "card", "phone"]
LABELS = ["O"] + [f"{part}-{kind}" for kind in KINDS for part in "BI"]
#: Words around a word with a digit or an at sign that are decoded with it.
AROUND = 4

_DOMAIN = re.compile(r"@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+")
_LOCAL = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-"
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_TRIGGER = re.compile(r"[0-9@]")
_WRITTEN_AT = re.compile(r"[0-9@]|[(\[]at[)\]]")
_DIGITS = re.compile(r"[0-9]")


# -- base patterns ------------------------------------------------------------------


def luhn(digits: str) -> bool:
    doubled = [int(d) for d in digits[-2::-2]]
    return (sum(map(int, digits[-1::-2])) + sum(2 * d - 9 * (d > 4) for d in doubled)) % 10 == 0


def emails(text: str) -> list[tuple[int, int]]:
    """Leftmost matches: from an at sign with a domain back over the characters a local part may have."""
    found, free = [], 0
    for m in _DOMAIN.finditer(text):
        before = text[free : m.start()]
        start = free + len(before.rstrip(_LOCAL))
        if start < m.start():
            found.append((start, m.end()))
            free = m.end()
    return found


def base_spans(text: str) -> list[Span]:
    """Leftmost matches of each kind that do not overlap; those that fail a check are dropped."""
    found: list[Span] = []
    if "@" in text:
        found += [("email", *s, True) for s in emails(text)]
    if _DIGITS.search(text):
        found += [("ip", *m.span(), True) for m in _IP.finditer(text) if all(len(p.lstrip("0")) <= 3 and int(p) <= 255 for p in m[0].split("."))]
        for m in _CARD.finditer(text):
            if m.end() - m.start() >= 12:
                digits = m[0].replace(" ", "").replace("-", "")
                if 12 <= len(digits) <= 19 and luhn(digits):
                    found.append(("card", *m.span(), True))
    if "+" in text:
        found += [("phone", *m.span(), True) for m in _PHONE.finditer(text) if 9 <= sum(c in "0123456789" for c in m[0]) <= 15]
    return found


# -- features -----------------------------------------------------------------------

_WORD = re.compile(r"\S+")
_LEADING, _TRAILING = "\"'<[{*#$%&!?,;:|=", "\"'>]}*#$%&!?,;:.|="


def trimmed(text: str, start: int, end: int) -> tuple[int, int]:
    """A word without the punctuation around it; brackets that belong to a number stay."""
    word = text[start:end]
    core = word.lstrip(_LEADING)
    start += len(word) - len(core)
    core = core.rstrip(_TRAILING)
    return start, start + len(core)


def shape(word: str) -> str:
    signs = ["9" if c.isdigit() else "A" if c.isupper() else "a" if c.isalpha() else c for c in word[:64]]
    return "".join(c for i, c in enumerate(signs) if i == 0 or signs[i - 1] != c)[:16]


def own_features(word: str) -> list[str]:
    digits = sum(c.isdigit() for c in word)
    pure = "pure" if digits == len(word) else "mixed" if any(c.isalpha() for c in word) else "signs"
    size = str(digits) if digits < 5 else "5-6" if digits < 7 else "7-8" if digits < 9 else "9-11" if digits < 12 else "12-19" if digits < 20 else "more"
    plain = not _WRITTEN_AT.search(word)
    return ["plain" if plain else f"shape={shape(word)}", f"digits={size},{pure}", f"first={word[:1] if not word[:1].isalnum() else 'x'}"]


def cue(word: str) -> str:
    return word.lower().rstrip(".:")[:12]


def features(words: list[str]) -> list[list[str]]:
    """The same number of features for every word: its own, and shapes and cues around it."""
    own = [own_features(w) for w in words]
    edge = ["edge", "edge", "edge"]
    at = lambda i: own[i] if 0 <= i < len(own) else edge
    cues = [cue(w) for w in words]
    said = lambda i: cues[i] if 0 <= i < len(cues) else "edge"
    return [
        [*own[i], f"before:{at(i - 1)[1]}", f"after:{at(i + 1)[1]}", f"after:{at(i + 1)[0]}", f"cue={said(i)}", f"cue-1={said(i - 1)}", f"cue-2={said(i - 2)}",
         f"cue-1={said(i - 1)},{own[i][1]}", f"cue+1={said(i + 1)}"]
        for i in range(len(words))
    ]


# -- the field ------------------------------------------------------------------------


class Field:
    """Weights of features and transitions; feature 0 is an unknown one and weighs nothing."""

    def __init__(self, places: dict[str, int], emit: np.ndarray, move: np.ndarray, start: np.ndarray):
        self.places, self.emit, self.move, self.start = places, emit, move, start

    def scores(self, words: list[str]) -> np.ndarray:
        return self.emit[np.array([[self.places.get(f, 0) for f in row] for row in features(words)])].sum(axis=1)

    def plain_margin(self) -> float:
        """By how much outside beats every other label for a plain word among plain words."""
        plain = self.scores(["word"] * 7)[3]
        return float(plain[0] - plain[1:].max())


def _log_sum(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis=axis, keepdims=True)
    return np.log(np.exp(x - top).sum(axis=axis)) + np.squeeze(top, axis)


def parsed_line(line: str) -> tuple[list[str], list[int]]:
    """Words and labels of a line in which spans are written as ``[kind|words]``."""
    words, labels = [], []
    for piece in re.finditer(r"\[(\w+)\|([^\]]*)\]|([^\[\]]+)", line):
        kind, inside, outside = piece.groups()
        for i, m in enumerate(_WORD.finditer(inside or outside)):
            a, b = trimmed(m[0], 0, len(m[0]))
            if a < b:
                words.append(m[0][a:b])
                labels.append(LABELS.index(f"{'I' if i else 'B'}-{kind}") if kind else 0)
    return words, labels


@functools.cache
def trained(rounds: int = 250, rate: float = 0.3, decay: float = 0.002) -> Field:
    """The field that fits the labelled lines, by full gradients with adaptive steps."""
    lines = [parsed_line(line) for line in LINES]
    named = sorted({f for words, _ in lines for row in features(words) for f in row})
    places = {f: i + 1 for i, f in enumerate(named)}
    n, longest, labels = len(lines), max(len(w) for w, _ in lines), len(LABELS)
    width = len(features(["x"])[0])
    ids, gold, here = np.zeros((n, longest, width), int), np.zeros((n, longest), int), np.zeros((n, longest), bool)
    for i, (words, own) in enumerate(lines):
        ids[i, : len(words)] = [[places[f] for f in row] for row in features(words)]
        gold[i, : len(words)], here[i, : len(words)] = own, True
    emit, move, start = np.zeros((len(places) + 1, labels)), np.zeros((labels, labels)), np.zeros(labels)
    gathered = [np.full_like(w, 1e-8) for w in (emit, move, start)]
    one = np.eye(labels)
    for _ in range(rounds):
        score = emit[ids].sum(axis=2)
        ahead, back = np.zeros((n, longest, labels)), np.zeros((n, longest, labels))
        ahead[:, 0] = start + score[:, 0]
        for t in range(1, longest):
            step = _log_sum(ahead[:, t - 1, :, None] + move, 1) + score[:, t]
            ahead[:, t] = np.where(here[:, t, None], step, ahead[:, t - 1])
        for t in range(longest - 2, -1, -1):
            step = _log_sum(move + (score[:, t + 1] + back[:, t + 1])[:, None, :], 2)
            back[:, t] = np.where(here[:, t + 1, None], step, 0)
        whole = _log_sum(ahead[:, -1], 1)
        chance = np.exp(ahead + back - whole[:, None, None]) * here[:, :, None]
        off = chance - one[gold] * here[:, :, None]
        d_emit = np.zeros_like(emit)
        np.add.at(d_emit, ids.reshape(-1), np.repeat(off.reshape(-1, labels), width, axis=0))
        d_move = np.zeros_like(move)
        for t in range(1, longest):
            pair = np.exp(ahead[:, t - 1, :, None] + move + (score[:, t] + back[:, t])[:, None, :] - whole[:, None, None])
            d_move += (pair * here[:, t, None, None]).sum(axis=0)
            np.add.at(d_move, (gold[here[:, t], t - 1], gold[here[:, t], t]), -1.0)
        d_start = off[:, 0].sum(axis=0)
        for weights, slope, sums in zip((emit, move, start), (d_emit, d_move, d_start), gathered):
            slope = slope + decay * n * weights
            sums += slope**2
            weights -= rate * slope / np.sqrt(sums)
        emit[0] = 0
    return Field(places, emit, move, start)


def viterbi(scores: list[np.ndarray], field: Field) -> list[np.ndarray]:
    """The best labels of many sequences, those of similar length decoded together."""
    result: list[np.ndarray] = [np.empty(0, int)] * len(scores)
    order = sorted(range(len(scores)), key=lambda i: len(scores[i]))
    for at in range(0, len(order), 512):
        group = order[at : at + 512]
        lengths = np.array([len(scores[i]) for i in group])
        longest = int(lengths.max())
        padded = np.zeros((len(group), longest, len(LABELS)))
        for row, i in enumerate(group):
            padded[row, : len(scores[i])] = scores[i]
        best, back = field.start + padded[:, 0], np.zeros((len(group), longest, len(LABELS)), np.int8)
        for t in range(1, longest):
            paths = best[:, :, None] + field.move
            back[:, t] = paths.argmax(axis=1)
            now = paths.max(axis=1) + padded[:, t]
            best = np.where((t < lengths)[:, None], now, best)
        label = best.argmax(axis=1)
        labels = np.zeros((len(group), longest), int)
        for t in range(longest - 1, -1, -1):
            inside = t < lengths
            labels[:, t] = np.where(inside, label, 0)
            if t:
                label = np.where(inside, back[np.arange(len(group)), t, label], label)
        for row, i in enumerate(group):
            result[i] = labels[row, : lengths[row]]
    return result


# -- decoding texts -----------------------------------------------------------------


def trigger_of(text: str) -> re.Pattern:
    """What calls for decoding in a text: a digit or an at sign, written out or not."""
    return _WRITTEN_AT if "(at)" in text or "[at]" in text else _TRIGGER


_PRECEDING = re.compile(r"(?:\S+\s+){0,%d}\S*$" % AROUND)


def windows(text: str) -> list[list[tuple[int, int]]]:
    """Stretches of trimmed words around those with a digit or an at sign, apart from one another."""
    found: list[list[tuple[int, int]]] = []
    at, free, length = 0, 0, len(text)  # ``free``: where the words after the last stretch begin
    trigger = trigger_of(text)
    while hit := trigger.search(text, at):
        left = hit.start()
        reach = max(free, left - 40 * AROUND)
        at = reach + _PRECEDING.search(text[reach:left]).start()
        while at > free and not text[at - 1].isspace():  # a long word from its beginning
            at -= 1
        words, kept, gap = [], 0, 0
        # on to the last word that has a trigger at most twice ``AROUND`` words before it, since stretches must not touch
        while gap <= 2 * AROUND and at < length and (m := _WORD.search(text, at)):
            at = m.end()
            a, b = trimmed(text, *m.span())
            if a < b:
                words.append((a, b))
                gap += 1
            if at > left and trigger.search(m[0]):
                kept, gap = len(words), 0
        at = max(at, hit.end())
        words = words[: kept + AROUND]
        free = words[-1][1] if words else at
        found.append(words)
    return [w for w in found if w]


def plausible(kind: str, words: str) -> bool:
    digits = sum(c.isdigit() for c in words)
    if kind == "email":
        return bool(re.search(r"@|[\[(]at[\])]", words)) and any(c.isalpha() for c in words)
    return {"ip": 4 <= digits <= 12, "card": 12 <= digits <= 19, "phone": 7 <= digits <= 15}[kind]


def find(texts: list[str], field: Field) -> list[list[Span]]:
    found: list[list[Span]] = [base_spans(text) if _TRIGGER.search(text) else [] for text in texts]
    places: list[tuple[int, list[tuple[int, int]]]] = []
    scores: list[np.ndarray] = []
    taken: dict[int, Taken] = {}

    def decode() -> None:
        for (i, words), labels in zip(places, viterbi(scores, field)):
            for kind, start, end in labelled(words, labels):
                if i not in taken:
                    taken[i] = Taken([(s, e) for _, s, e, base in found[i] if base])
                if plausible(kind, texts[i][start:end]) and not taken[i].overlaps(start, end):
                    found[i].append((kind, start, end, False))
        places.clear()
        scores.clear()

    held = 0
    for i, text in enumerate(texts):
        for words in windows(text):
            places.append((i, words))
            scores.append(field.scores([text[a:b] for a, b in words]))
            held += len(words)
            if held >= 50_000:
                decode()
                held = 0
    decode()
    return found


def labelled(words: list[tuple[int, int]], labels: np.ndarray) -> list[tuple[str, int, int]]:
    """The spans that a label sequence marks."""
    spans: list[tuple[str, int, int]] = []
    inside = None
    for (start, end), label in zip(words, labels.tolist()):
        part, _, kind = LABELS[label].partition("-")
        if part == "I" and inside == kind:
            spans[-1] = (kind, spans[-1][1], end)
        elif part != "O":
            spans.append((kind, start, end))
        inside = kind or None
    return spans


def personal_data(docs: DataFrame, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """``docs`` (or its columns ``keep``) with ``spans`` of personal data in the whole texts."""
    field = trained()
    if field.plain_margin() <= 2 * float(np.abs(field.move).max()):
        raise ValueError("plain words are not far enough outside; decode without windows")
    return with_spans(docs, lambda texts: find(texts, field), KINDS, text, keep)
