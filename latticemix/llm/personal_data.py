"""Personal data in texts: fixed patterns, and a semi-Markov conditional random field beside them.

The base finds emails, addresses, cards and phones by pattern.  The field scores
whole candidate segments by features of the entire span (its shape, digits,
groups, signs, neighbours), and a dynamic program over segments of at most
``MAX_TOKENS`` tokens chooses boundaries and kinds together.  Base spans stay;
the program adds the best segments that are free of them.  So it finds two card
numbers in a row, a phone with a number behind it, or a card with a mistyped
digit, which a pattern reads as one failing match.

Only stretches around digits and at signs hold candidates.  The field learns from
such stretches of all documents, those without a failing base match: base spans
are its examples, all else is none.  Stretches of equal features count once with
their number, and the ``FIT_STRETCHES`` most frequent ones are fitted.
"""

from __future__ import annotations

import hashlib
import re
from ast import literal_eval
from bisect import bisect_left, bisect_right
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

KINDS = ("email", "ip", "card", "phone")
# Tokens of a segment; stretches that are fitted and their tokens; passes of the fit.
MAX_TOKENS = 24
FIT_STRETCHES, FIT_TOKENS = 2000, 48
PASSES, STEP, SHRINK = 60, 0.5, 1e-3
# Characters looked back for the beginning of a stretch, and ahead for the next chunk's digit.
LOOK_BACK = 256
# Decoded stretches kept per worker, and different stretches counted at once.
CACHE = 200_000
_BUCKETS = 1 << 13

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_DOTTED = re.compile(r"[0-9]+(?:\.[0-9]+)+")
_DIGITS = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_TRIGGER = re.compile(r"[0-9@]")
_STRETCH = re.compile(r"[^ \t-\r]+(?: {1,2}(?=[^ \t-\r]{0,64}?[0-9@])[^ \t-\r]+)*")
_TOKEN = re.compile(r"[0-9]+|[A-Za-z]+| +|[^\W\d_A-Za-z]+|.", re.S)
_BLANK = " \t\n\x0b\x0c\r"
Span = tuple[int, int, int]  # kind, start, end


# -- base -------------------------------------------------------------------------


def luhn(digits: str) -> bool:
    """Whether the check digit holds."""
    twice = [d * 2 - 9 * (d > 4) for d in map(int, digits[-2::-2])]
    return (sum(twice) + sum(map(int, digits[-1::-2]))) % 10 == 0


def _emails(text: str) -> Iterator[tuple[int, int]]:
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        found = _DOMAIN.match(text, at + 1) if start < at else None
        if found:
            yield start, found.end()
        done = found.end() if found else at + 1
        at = text.find("@", done)


def _addresses(text: str) -> Iterator[tuple[int, int, bool]]:
    for found in _DOTTED.finditer(text):
        parts, at = found[0].split("."), found.start()
        ends = np.cumsum([len(p) + 1 for p in parts]) - 1
        for i in range(0, len(parts) - 3, 4):
            small = all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in parts[i : i + 4])
            yield at + (int(ends[i - 1]) + 1 if i else 0), at + int(ends[i + 3]), small


def base_spans(text: str) -> tuple[list[Span], list[tuple[int, int]]]:
    """Base spans by start, then kind, and the places of matches that were dropped."""
    spans, dropped = [], []
    if "@" in text:
        spans += [(0, a, b) for a, b in _emails(text)]

    def judge(kind: int, start: int, end: int, good: bool) -> None:
        if good:
            spans.append((kind, start, end))
        else:
            dropped.append((start, end))

    for start, end, good in _addresses(text):
        judge(1, start, end, good)
    for found in _DIGITS.finditer(text):
        digits = found[0].replace(" ", "").replace("-", "")
        if len(digits) >= 14:
            judge(2, *found.span(), len(digits) <= 19 and luhn(digits))
    if "+" in text:
        for found in _PHONE.finditer(text):
            judge(3, *found.span(), 10 <= sum("0" <= c <= "9" for c in found[0]) <= 15)
    return sorted(spans, key=lambda s: (s[1], s[0])), dropped


# -- stretches and their segments ---------------------------------------------------


def _class(token: str) -> str:
    first = token[0]
    if "0" <= first <= "9":
        small = len(token) <= 3 and int(token) <= 255
        return f"9{min(len(token), 20)}{'<' if small else ''}"
    if first == " ":
        return " "
    if first.isalpha():
        return "a" if first.isascii() else "ä"
    return first


@dataclass(frozen=True)
class Stretch:
    """Tokens around a digit or an at sign: their places, their classes, and the classes on both sides."""

    edges: list[int]
    classes: tuple[str, ...]


def stretches(text: str) -> Iterator[Stretch]:
    done = 0
    while found := _TRIGGER.search(text, done):
        at = found.start()
        low = max(done, at - LOOK_BACK)
        start = 1 + max(text.rfind(c, low, at) for c in _BLANK)
        start = max(start, low)
        region = _STRETCH.match(text, start)
        tokens = _TOKEN.findall(region[0])
        edges = np.cumsum([start, *map(len, tokens)]).tolist()
        done = region.end()
        left = _class(text[start - 1])[:1] if start else "^"
        right = _class(text[done])[:1] if done < len(text) else "$"
        yield Stretch(edges, (left, *map(_class, tokens), right))


def _hashed(*parts) -> int:
    return int.from_bytes(hashlib.blake2b(repr(parts).encode(), digest_size=4).digest(), "little") % _BUCKETS


_numbers: dict[tuple, int] = {}


def _number(*parts) -> int:
    if parts not in _numbers:
        if len(_numbers) > CACHE:
            _numbers.clear()
        _numbers[parts] = _hashed(*parts)
    return _numbers[parts]


def segments(classes: tuple[str, ...], taken: frozenset[int] = frozenset()) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First token, end, and features of every candidate segment without a token of ``taken``.

    A candidate begins and ends at the edge of a run of letters and digits, not
    with a blank, and holds a digit or one at sign.
    """
    left, tokens, right = classes[0], classes[1:-1], classes[-1]
    n = len(tokens)
    worded = [c[0] in "9aä" for c in tokens]
    digits = [int(c[1:].rstrip("<")) if c[0] == "9" else 0 for c in tokens]
    begins = [
        tokens[i] != " " and not (worded[i] and (worded[i - 1] if i else left[0] in "9aä")) for i in range(n)
    ]
    ends = [
        tokens[i] != " " and not (worded[i] and (worded[i + 1] if i + 1 < n else right[0] in "9aä")) for i in range(n)
    ]
    first, last, features = [], [], []
    for i in range(n):
        if not begins[i] or i in taken:
            continue
        before = tokens[i - 1][0] if i else left[0]
        for j in range(i + 1, min(i + MAX_TOKENS, n) + 1):
            if j - 1 in taken or tokens[j - 1] == "@" in tokens[i : j - 1]:
                break
            if not ends[j - 1]:
                continue
            span = tokens[i:j]
            total, signs = sum(digits[i:j]), "".join(sorted({c[0] for c in span}))
            if not ("9" in signs or "@" in signs):
                continue
            groups = [c for c in span if c[0] == "9"]
            after = tokens[j][0] if j < n else right[0]
            first.append(i)
            last.append(j)
            features.append(
                (
                    _number("shape", span),
                    _number("digits", min(total, 20)),
                    _number("groups", min(len(groups), 9), min(total, 20)),
                    _number("signs", signs),
                    _number("at", span.count("@"), span.count(".")),
                    _number("dots", span.count("."), len(groups)),
                    _number("ends", span[0][0], span[-1][0]),
                    _number("before", before),
                    _number("after", after),
                    _number("small", all(c[-1] == "<" for c in groups), len(groups) == 4),
                    _number("round", span.count("(") == span.count(")"), span.count("(")),
                    _number("tokens", min(j - i, 12)),
                )
            )
    width = 12
    return np.array(first, np.int64), np.array(last, np.int64), np.array(features, np.int64).reshape(-1, width)


# -- the field ----------------------------------------------------------------------


def _log_sum(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis, keepdims=True)
    top = np.where(np.isfinite(top), top, 0)
    with np.errstate(divide="ignore"):
        return np.log(np.exp(x - top).sum(axis)) + np.squeeze(top, axis)


@dataclass
class SemiMarkov:
    """Weights of features per kind and of steps from one segment's kind to the next; kind 0 is a token outside."""

    weights: np.ndarray
    steps: np.ndarray

    @classmethod
    def empty(cls) -> SemiMarkov:
        return cls(np.zeros((_BUCKETS, len(KINDS))), np.zeros((len(KINDS) + 1, len(KINDS) + 1)))

    def decode(self, classes: tuple[str, ...], taken: frozenset[int] = frozenset()) -> list[Span]:
        """The best labelling's segments as (kind, first token, end); ties leave tokens outside."""
        first, last, features = segments(classes, taken)
        if not len(first):
            return []
        scores = self.weights[features].sum(1)
        n, ending = len(classes) - 2, {}
        for s, j in enumerate(last.tolist()):
            ending.setdefault(j, []).append(s)
        best = np.full((n + 1, len(KINDS) + 1), -np.inf)
        best[0, 0] = 0
        back: dict[tuple[int, int], tuple[int, int]] = {}
        for j in range(1, n + 1):
            into = best[j - 1] + self.steps[:, 0]
            k = int(into.argmax())
            best[j, 0], back[j, 0] = into[k], (j - 1, k)
            for s in ending.get(j, ()):
                i = int(first[s])
                into = best[i][:, None] + self.steps[:, 1:]
                k = into.argmax(0)
                found = into.max(0) + scores[s]
                for t in np.flatnonzero(found > best[j, 1:]).tolist():
                    best[j, t + 1], back[j, t + 1] = found[t], (i, int(k[t]))
        j, kind, out = n, int(best[n].argmax()), []
        while j:
            i, before = back[j, kind]
            if kind:
                out.append((kind - 1, i, j))
            j, kind = i, before
        return out[::-1]


def fit_field(examples: list[tuple[tuple[str, ...], tuple[Span, ...], int]]) -> SemiMarkov:
    """Weights of largest conditional likelihood, shrunk, by forward and backward sums over all segmentations.

    ``examples``: classes of a stretch, its spans in tokens, its number.
    """
    field = SemiMarkov.empty()
    parts = [segments(classes) for classes, _, _ in examples]
    if not any(spans for _, spans, _ in examples):
        return field
    k, n_kinds = len(examples), len(KINDS)
    sizes = np.array([len(classes) - 2 for classes, _, _ in examples])
    amount = np.log1p([n for _, _, n in examples])
    of = np.repeat(np.arange(k), [len(p[0]) for p in parts])
    first, last, features = (np.concatenate([p[i] for p in parts]) for i in range(3))
    place = {(r, i, j): s for s, (r, i, j) in enumerate(zip(of.tolist(), first.tolist(), last.tolist()))}
    gold, gold_steps = np.zeros((len(of), n_kinds)), np.zeros((n_kinds + 1, n_kinds + 1))
    for r, (_, spans, _) in enumerate(examples):
        before, at = 0, 0
        for kind, i, j in (*spans, (-1, int(sizes[r]), 0)):
            outside = i - at
            if outside:
                gold_steps[before, 0] += amount[r]
                gold_steps[0, 0] += amount[r] * (outside - 1)
                before = 0
            if kind >= 0:
                gold[place[r, i, j], kind] += amount[r]
                gold_steps[before, kind + 1] += amount[r]
                before, at = kind + 1, j
    top = int(sizes.max())
    by_end = [np.flatnonzero(last == j) for j in range(top + 1)]
    by_first = [np.flatnonzero(first == j) for j in range(top + 1)]
    inside = sizes[:, None] >= np.arange(top + 1)
    past_w, past_s = np.full(field.weights.shape, 1e-8), np.full(field.steps.shape, 1e-8)
    for _ in range(PASSES):
        scores = field.weights[features].sum(1)
        ahead = np.full((k, top + 1, n_kinds + 1), -np.inf)
        ahead[:, 0, 0] = 0
        entered = np.full((k, top + 1, n_kinds + 1), -np.inf)  # sums up to a token, and the step into a kind
        for j in range(top + 1):
            if j:
                ahead[:, j, 0] = entered[:, j - 1, 0]
                s = by_end[j]
                for t in range(n_kinds):
                    np.logaddexp.at(ahead[:, j, t + 1], of[s], entered[of[s], first[s], t + 1] + scores[s, t])
            entered[:, j] = _log_sum(ahead[:, j, :, None] + field.steps, 1)
        whole = _log_sum(ahead[np.arange(k), sizes], 1)
        behind = np.full((k, top + 1, n_kinds + 1), -np.inf)
        leaving = np.full((k, top + 1, n_kinds + 1), -np.inf)  # sums of what begins at a token, by its kind
        for j in range(top, -1, -1):
            if j < top:
                leaving[:, j, 0] = behind[:, j + 1, 0]
                s = by_first[j]
                for t in range(n_kinds):
                    np.logaddexp.at(leaving[:, j, t + 1], of[s], scores[s, t] + behind[of[s], last[s], t + 1])
                behind[:, j] = _log_sum(field.steps + leaving[:, j, None, :], 2)
            behind[sizes == j, j] = 0
        chance = np.exp(entered[of, first, 1:] + scores + behind[of, last, 1:] - whole[of][:, None])
        passed = ahead[..., :, None] + field.steps + leaving[..., None, :] - whole[:, None, None, None]
        passed = np.where(inside[..., None, None], np.exp(passed), 0)
        grad_s = gold_steps - (passed * amount[:, None, None, None]).sum((0, 1)) - SHRINK * field.steps
        grad_w = -SHRINK * field.weights
        change = gold - chance * amount[of][:, None]
        for column in features.T:
            np.add.at(grad_w, column, change)
        past_w += grad_w**2
        past_s += grad_s**2
        field.weights += STEP * grad_w / np.sqrt(past_w)
        field.steps += STEP * grad_s / np.sqrt(past_s)
    return field


# -- documents ------------------------------------------------------------------------


def _tokens_of(stretch: Stretch, start: int, end: int) -> tuple[int, int] | None:
    """The tokens that the characters cover, if they begin and end at tokens' edges."""
    i, j = bisect_left(stretch.edges, start), bisect_left(stretch.edges, end)
    return (i, j) if i < len(stretch.edges) and stretch.edges[i] == start and j < len(stretch.edges) and stretch.edges[j] == end else None


def example(stretch: Stretch, spans: list[Span], doubtful: bool) -> tuple | None:
    """What the field learns from a stretch: its classes and spans in tokens.  Nothing if it holds what isn't sure."""
    if len(stretch.classes) - 2 > FIT_TOKENS or doubtful:
        return None
    out, at = [], 0
    for kind, a, b in spans:
        tokens = _tokens_of(stretch, a, b)
        if tokens is None or tokens[0] < at or tokens[1] - tokens[0] > MAX_TOKENS:
            return None
        out.append((kind, *tokens))
        at = tokens[1]
    if out:
        first, last, _ = segments(stretch.classes)
        if not {s[1:] for s in out} <= set(zip(first.tolist(), last.tolist())):
            return None
    return stretch.classes, tuple(out)


def _with_triggers(column: pa.Array) -> Iterator[tuple[int, str]]:
    """(row, text) of texts that hold a digit or an at sign."""
    found = pc.fill_null(pc.match_substring_regex(column, "[0-9@]"), False).to_numpy(zero_copy_only=False)
    for i in np.flatnonzero(found).tolist():
        yield i, column[i].as_py()


def fit(docs: DataFrame, stretches_fitted: int = FIT_STRETCHES) -> SemiMarkov:
    """The field from the most frequent stretches of all ``docs``, at most ``stretches_fitted`` different ones."""

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: Counter = Counter()

        def batch() -> pa.RecordBatch:
            rows = [repr(k) for k in found]
            out = pa.RecordBatch.from_arrays([pa.array(rows, pa.string()), pa.array(found.values(), pa.int64())], ["example", "n"])
            found.clear()
            return out

        for part in batches:
            for _, text in _with_triggers(part.column(0)):
                near = _Near(*base_spans(text))
                for stretch in stretches(text):
                    if known := example(stretch, *near.of(stretch)):
                        found[known] += 1
            if len(found) > CACHE:
                yield batch()
        yield batch()

    seen = docs.select(F.col("text").cast("string")).mapInArrow(learn, "example string, n long")
    counted = seen.groupBy("example").agg(F.sum("n").alias("n"))
    chosen = counted.orderBy(F.desc("n"), "example").limit(stretches_fitted).collect()
    return fit_field([(*literal_eval(r.example), r.n) for r in chosen])


class _Near:
    """Base spans of a text by stretch, for stretches in text order."""

    def __init__(self, spans: list[Span], dropped: list[tuple[int, int]] = ()):
        self.spans, self.dropped = list(spans), sorted(dropped)

    def of(self, stretch: Stretch) -> tuple[list[Span], bool]:
        """The spans that meet the stretch, and whether a dropped match does."""
        low, high = stretch.edges[0], stretch.edges[-1]
        found = []
        for rows, start, end in ((self.spans, 1, 2), (self.dropped, 0, 1)):
            n = 0
            while n < len(rows) and rows[n][start] < high:
                n += 1
            found.append([r for r in rows[:n] if r[end] > low])
            rows[:n] = [r for r in rows[:n] if r[end] > high]  # the rest lies before the next stretch
        return found[0], bool(found[1])


class Finder:
    """Adds the field's spans to base spans; equal stretches are decoded once per worker."""

    def __init__(self, field: SemiMarkov):
        self.field, self.decoded = field, {}

    def added(self, text: str, spans: list[Span]) -> list[Span]:
        out, near = [], _Near(spans)
        for stretch in stretches(text):
            taken = set()
            for _, a, b in near.of(stretch)[0]:
                taken.update(range(max(bisect_right(stretch.edges, a) - 1, 0), bisect_left(stretch.edges, b)))
            key = stretch.classes, frozenset(taken)
            if key not in self.decoded:
                if len(self.decoded) > CACHE:
                    self.decoded.clear()
                self.decoded[key] = self.field.decode(*key)
            out += [(kind, stretch.edges[i], stretch.edges[j]) for kind, i, j in self.decoded[key]]
        return out


def _told(spans: list[Span]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for k, a, b in spans)


_COUNTS = ", ".join(f"n_{k} long" for k in KINDS)


def find(docs: DataFrame, field: SemiMarkov) -> DataFrame:
    """(doc_id, n_email, n_ip, n_card, n_phone, base, spans) of every row of ``docs``.

    The counts are of base spans; ``base`` and ``spans`` (base and added ones)
    list kind:start:end in code points, by start, then kind.
    """
    shared = docs.sparkSession.sparkContext.broadcast(field)  # of fixed size
    finders: list[Finder] = []

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if not finders:
            finders.append(Finder(shared.value))
        for batch in batches:
            n = len(batch)
            counts, base, spans = np.zeros((len(KINDS), n), np.int64), [""] * n, [""] * n
            for i, text in _with_triggers(batch.column(1)):
                found, _ = base_spans(text)
                for kind, _, _ in found:
                    counts[kind, i] += 1
                every = sorted(found + finders[0].added(text, found), key=lambda s: (s[1], s[0]))
                base[i], spans[i] = _told(found), _told(every)
            columns = [batch.column(0), *map(pa.array, counts), pa.array(base), pa.array(spans)]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", *(f"n_{k}" for k in KINDS), "base", "spans"])

    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return rows.mapInArrow(search, f"doc_id long, {_COUNTS}, base string, spans string")


def find_personal_data(docs: DataFrame) -> DataFrame:
    """Fit the field on ``docs`` and search every row of them.

    Null and empty texts have no spans; a whole text is searched, whatever its
    length; repeated rows give equal results; null ids stay; an empty table gives
    no rows; other columns are ignored.  Without a base span in the table the
    field adds nothing.
    """
    return find(docs, fit(docs))
