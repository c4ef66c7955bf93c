"""Operator 4, secret scans: three fixed patterns, and a linear-chain conditional
random field that tags tokens as begin, inside or outside of a secret.

The field reads the whole text as one sequence of tokens.  Features of a token are its
own shape, length, share of digits, letters in hexadecimal and spread of characters, the
words and shapes of two neighbours to either side, and of the file whether it looks like
code and how dense its digits are.  Viterbi finds the best tags of the whole sequence:
first every token is scored at once, and one that no best sequence can tag but as outside
(for whichever neighbouring tags, tagging it so gains) parts the text; between such
tokens the best tags don't depend on the rest and are found step by step.

The field is trained on the spans of the fixed patterns in a bounded sample of pieces of
all documents, drawn by stratum: *windows*, which are the words around every run of eight
or more key-like characters with a digit and around every credential word, and plain
text, of which a row gives one piece without a window, at a hashed place.  Of the
distinct windows with a secret the lowest by hash, up to half of ``FIT_WINDOWS``, then
``PLAIN_PIECES`` of plain text, and for the rest windows without a secret; one row gives
at most ``ROW_WINDOWS`` to each stratum of windows, and a window of more than
``WINDOW_TOKENS`` counts as several.  Each window with a secret counts once as it is
and once with the credential words around removed, so that shape alone must also tell.
Training maximizes the conditional likelihood; only where no window of the whole table
holds a secret the field finds none.  Its spans are reported where they don't overlap
one of the patterns', whose spans always stay.

Rows: null text counts as empty and has no spans; repeated rows get equal results; an
empty table gives no rows; columns other than ``doc_id`` and ``text`` are ignored.
"""

from __future__ import annotations

import re
from array import array
from collections.abc import Callable, Iterable
from functools import lru_cache
from hashlib import blake2b
from itertools import islice
from math import log2

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Row, SparkSession, functions as F

from hindcast.llm.common import map_texts, ship_code, slices, stored, texts
from hindcast.sources.tables import read_table

FIT_WINDOWS, ROW_WINDOWS, WINDOW_TOKENS, PLAIN_PIECES = 4000, 4, 400, 500
EPOCHS, RATE, SHRINK = 6, 0.2, 1e-4
REACH = 48
#: Characters tokenized and tokens scored at a time, and tokens whose marks are kept.
PIECE_CHARS, PIECE_TOKENS, KNOWN_TOKENS = 1 << 18, 1 << 15, 1 << 19
KINDS = ["assign", "access", "hex", "crf"]

# The patterns that the scan promises.
_ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]{24,}")
_KEYS = ("passw", "secret", "token", "apikey", "api_key")

_RUN = re.compile(r"[0-9][A-Za-z0-9+/_.=-]*")
_BEFORE = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz+/_.=-")
_CREDENTIALS = ("passw", "passp", "secret", "token", "apikey", "api_key", "credential", "private", "bearer", "auth")
_CREDENTIAL = re.compile(r"pass(?:word|wd|phrase)|secret|token|api_?key|credential|private[_ ]key|bearer|auth", re.I | re.A)
_TOKEN = re.compile(r"[A-Za-z0-9+/_.-]+|[^\sA-Za-z0-9+/_.-]")
_OUT, _BEGIN, _IN = 0, 1, 2
#: Places of the neighbours that a token's features name.
AROUND = (-3, -2, -1, 1, 2)

Span = tuple[str, int, int]
Window = tuple[list[str], list[tuple[int, int]], list[str]]  # tokens, their places, file features


def base_spans(text: str) -> list[Span]:
    """The fixed patterns' spans: whole matches, code points, end exclusive."""
    found: list[Span] = []
    low = text.lower()
    if any(k in low for k in _KEYS):
        found += [("assign", m.start(), m.end()) for m in _ASSIGN.finditer(text) if len(m.group(2)) >= 6]
    if "AKIA" in text:
        found += [("access", m.start(), m.end()) for m in _ACCESS.finditer(text) if m.end() - m.start() >= 20]
    found += [("hex", m.start(), m.end()) for m in _HEX.finditer(text)]
    return sorted(found, key=lambda s: (s[1], KINDS.index(s[0])))


def secret_places(text: str) -> list[tuple[int, int]]:
    """Where the secrets themselves stand that the patterns find, without their names."""
    found = [m.span(2) for m in _ASSIGN.finditer(text) if len(m.group(2)) >= 6]
    found += [m.span() for m in _ACCESS.finditer(text) if m.end() - m.start() >= 20]
    return found + [m.span() for m in _HEX.finditer(text)]


def file_features(text: str) -> list[str]:
    """How dense a text's digits are, and how much it looks like code."""
    many = sum(map(text.count, "0123456789")) if text.isascii() else sum(map(str.isdigit, text))
    digits = many / max(len(text), 1)
    code = sum(text.count(c) for c in "{};=") / max(len(text), 1)
    return [f"file:digits{min(int(digits * 50), 5)}", f"file:code{min(int(code * 200), 3)}"]


def _grown(text: str, a: int, b: int) -> tuple[int, int]:
    """``a`` and ``b`` moved outwards to white space."""
    while a and not text[a - 1].isspace():
        a -= 1
    while b < len(text) and not text[b].isspace():
        b += 1
    return a, b


def _read(text: str, a: int, b: int, file: list[str]) -> Window:
    places = [m.span() for m in _TOKEN.finditer(text, a, b)]
    return [text[x:y] for x, y in places], places, file


def windows(text: str) -> list[Window]:
    """The words around key-like runs and credential words, to train on."""
    at = []
    for m in _RUN.finditer(text):  # from a run's first digit on; what stands before it has none
        a, b = m.span()
        while a and text[a - 1] in _BEFORE:
            a -= 1
        if b - a >= 8:
            at.append((a, b))
    low = text.lower()
    if any(k in low for k in _CREDENTIALS):
        at += [m.span() for m in _CREDENTIAL.finditer(text)]
    if not at:
        return []
    joined: list[list[int]] = []
    for a, b in sorted(at):
        a, b = max(0, a - REACH), min(len(text), b + REACH)
        if joined and a <= joined[-1][1]:
            joined[-1][1] = max(joined[-1][1], b)
        else:
            joined.append([a, b])
    file = file_features(text)
    return [_read(text, *_grown(text, a, b), file) for a, b in joined]


def plain(text: str, found: list[Window]) -> Window | None:
    """The words around a hashed place of a text, to train on; None if one of ``found``
    is there."""
    if not text:
        return None
    at = int.from_bytes(blake2b(text.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little") % len(text)
    a, b = _grown(text, max(0, at - REACH), min(len(text), at + REACH))
    if any(places and places[0][0] < b and a < places[-1][1] for _, places, _ in found):
        return None
    piece = _read(text, a, b, file_features(text))
    return piece if piece[0] else None


class _Kinds(dict):
    """By code point, what a shape shows of it."""

    def __missing__(self, code: int) -> str:
        c = chr(code)
        kind = self[code] = "9" if c.isdigit() else "A" if c.isupper() else "a" if c.islower() else c
        return kind


_KIND = _Kinds()
_AGAIN = re.compile(r"(.)\1+", re.S)


def _shape(kinds: str) -> str:
    """The shape of a token of these kinds."""
    s = kinds[:64]
    return s[0] if s.count(s[0]) == len(s) else _AGAIN.sub(r"\1", s)[:10]


@lru_cache(1 << 14)
def _spread(counts: tuple[int, ...]) -> int:
    """Whole bits of entropy of the characters that occur so many times."""
    n = sum(counts)
    return int(-sum(k / n * log2(k / n) for k in counts))


def _marks(token: str, named: bool = True) -> tuple:
    """What a token's own features are made of: few different ones for many tokens."""
    n = len(token)
    word = token.islower() and token.isalpha() and token.isascii()  # most tokens by far
    kinds = "a" if word else token.translate(_KIND)
    if named and n > 3 and _CREDENTIAL.search(token):
        return ("credential", _shape(kinds))
    if n == 1 and not token.isalnum():
        return (f"sign:{token}", _shape(kinds))
    spread = _spread(tuple(sorted(map(token.count, set(token)))))
    hexadecimal = not token.strip("0123456789abcdefABCDEF")
    if word:
        return ("", "a", min(n // 4, 8), 0, spread, hexadecimal, False, False, True)
    return ("", _shape(kinds), min(n // 4, 8), int(kinds.count("9") / n * 4), spread, hexadecimal, "9" in kinds, "A" in kinds, "a" in kinds)


def _own(marks: tuple) -> list[str]:
    if marks[0]:
        return [marks[0]]
    _, shape, length, digits, spread, hexadecimal, *mixed = marks
    return [f"shape:{shape}", f"length:{length}", f"digits:{digits}/{length}", f"spread:{spread}",
            f"hex:{hexadecimal}/{length}", f"mixed:{tuple(mixed)}/{length}", f"turns:{min(len(shape) // 3, 3)}/{length}"]


def _shown(marks: tuple) -> str:
    """What a token's neighbours see of it."""
    return "credential" if marks[0] == "credential" else marks[1][:4]


def features(tokens: list[str], file: list[str], named: bool = True) -> list[list[str]]:
    """Feature names of each token; without ``named`` credential words don't show."""
    made = [_marks(t, named) for t in tokens]
    seen = ["a" if not named and _CREDENTIAL.search(t) else _shown(m) for t, m in zip(tokens, made)]
    out = []
    for i, m in enumerate(made):
        around = [f"{k}:{seen[i + k] if 0 <= i + k < len(tokens) else '-'}" for k in AROUND]
        own = _own(m)
        out.append(["bias", *own, *around, *(f"{x}+{own[0]}" for x in file)])
    return out


class _Numbers(dict):
    """Tokens' numbers, each asked for once."""

    def __init__(self, learn: Callable[[str], int]):
        self.learn = learn

    def __missing__(self, token: str) -> int:
        n = self[token] = self.learn(token)
        return n


class Field:
    """Weights by feature name (rows of three tags), transitions and first tags."""

    def __init__(self, names: dict[str, int], weights: np.ndarray, steps: np.ndarray, first: np.ndarray):
        self.names, self.weights, self.steps, self.first = names, weights, steps, first
        self.tables: dict | None = None

    def __getstate__(self):
        return self.__dict__ | {"tables": None}

    def _sum(self, features: Iterable[str]) -> np.ndarray:
        return self.weights[[self.names[f] for f in features if f in self.names]].sum(axis=0)

    def scores(self, rows: list[list[str]]) -> np.ndarray:
        return np.array([self._sum(fs) for fs in rows])

    def tags(self, rows: list[list[str]]) -> list[int]:
        """Viterbi."""
        return self._best(self.scores(rows), self.first, np.zeros(3)) if rows else []

    def _best(self, score: np.ndarray, before: np.ndarray, after: np.ndarray) -> list[int]:
        """The best tags of tokens of these scores; ``before`` counts for the first one's
        tag, ``after`` for the last one's."""
        (a, b, c), (d, e, f), (g, h, i) = self.steps.tolist()
        rows = score.tolist()
        x, y, z = (p + q for p, q in zip(rows[0], before.tolist()))
        back = []
        for p, q, r in rows[1:]:
            o, s, t = max((x + a, 0), (y + d, 1), (z + g, 2)), max((x + b, 0), (y + e, 1), (z + h, 2)), max((x + c, 0), (y + f, 1), (z + i, 2))
            back.append((o[1], s[1], t[1]))
            x, y, z = o[0] + p, s[0] + q, t[0] + r
        end = [x + after[0], y + after[1], z + after[2]]
        tag = end.index(max(end))
        out = [tag]
        for ways in reversed(back):
            out.append(tag := ways[tag])
        return out[::-1]

    def _prepare(self) -> dict:
        """What a token's scores are summed up from: by its marks, by what a neighbour
        shows, and by the file and its first feature."""
        prev, after = np.vstack([self.steps, self.first]), np.hstack([self.steps, np.zeros((3, 1))])
        # what tagging a token as outside gains at least in steps, in place of begin and inside
        freed = [min(prev[:, _OUT] - prev[:, x]) for x in (_BEGIN, _IN)]
        alone = [min((after[_OUT] - after[x])[[_OUT, _BEGIN, 3]]) for x in (_BEGIN, _IN)]  # the next is not inside
        chained = [after[_OUT, _BEGIN] - after[x, _IN] + min(after[_BEGIN] - after[_IN]) for x in (_BEGIN, _IN)]  # it was, and now begins
        t = {"marks": {}, "shown": {"-": 0}, "led": {}, "own": np.zeros((64, 3)), "show": np.zeros(64, np.int32), "lead": np.zeros(64, np.int32),
             "around": np.array([[self._sum([f"{k}:-"])] for k in AROUND]), "file": {},
             "alone": np.add(freed, alone), "chained": np.add(freed, chained)}
        t["known"] = _Numbers(lambda token: self._learn(t, _marks(token)))
        return t

    def _learn(self, t: dict, marks: tuple) -> int:
        if marks not in t["marks"]:
            n = t["marks"][marks] = len(t["marks"])
            if n == len(t["own"]):
                for k in ("own", "show", "lead"):
                    t[k] = np.concatenate([t[k], np.zeros_like(t[k])])
            own, shows = _own(marks), _shown(marks)
            if shows not in t["shown"]:
                t["shown"][shows] = len(t["shown"])
                t["around"] = np.concatenate([t["around"], [[self._sum([f"{k}:{shows}"])] for k in AROUND]], axis=1)
            t["own"][n], t["show"][n], t["lead"][n] = self._sum(["bias", *own]), t["shown"][shows], t["led"].setdefault(own[0], len(t["led"]))
        return t["marks"][marks]

    def _numbers(self, t: dict, text: str) -> tuple[np.ndarray, list[tuple[int, int, int]]]:
        """The number of each token's marks, and the pieces of the text: first token, start, end."""
        parts, pieces, at, n = [], [], 0, 0
        while at < len(text):
            end = min(at + PIECE_CHARS, len(text))
            while end < len(text) and not text[end].isspace():
                end += 1
            found = _TOKEN.findall(text, at, end)
            if len(t["known"]) > KNOWN_TOKENS:
                t["known"].clear()
            pieces.append((n, at, end))
            parts.append(np.fromiter(map(t["known"].__getitem__, found), np.int32, len(found)))
            at, n = end, n + len(found)
        return np.concatenate(parts) if parts else np.zeros(0, np.int32), pieces

    def tagged(self, text: str) -> list[tuple[int, int, int]]:
        """(tag, start, end) of the tokens that the best tags of the whole text don't
        leave outside, in order."""
        if self.tables is None or len(self.tables["marks"]) > KNOWN_TOKENS:
            self.tables = self._prepare()
        t = self.tables
        numbers, pieces = self._numbers(t, text)
        n = len(numbers)
        if not n:
            return []
        file = tuple(file_features(text))
        mine = t["file"].get(file, np.zeros((0, 3)))
        if len(mine) < len(t["led"]):
            more = [self._sum([f"{x}+{lead}" for x in file]) for lead in islice(t["led"], len(mine), None)]
            mine = t["file"][file] = np.concatenate([mine, more])
        show = np.zeros(n + 5, np.int32)  # three before and two after show "-"
        show[3:n + 3] = t["show"][numbers]

        def scores(at: np.ndarray) -> np.ndarray:
            x = numbers[at]
            out = t["own"][x] + mine[t["lead"][x]]
            for k, weights in zip(AROUND, t["around"]):
                out += weights[show[at + (3 + k)]]
            return out

        # most tokens are certain by their marks, whatever of this text stands around them
        m = len(t["marks"])
        alone = t["own"][:m] + mine[t["lead"][:m]]
        around = t["around"][:, np.flatnonzero(np.bincount(show))]
        over = alone[:, 1:] - alone[:, :1] + (around[:, :, 1:] - around[:, :, :1]).max(axis=1).sum(axis=0)
        follows = (alone[:, _IN] - alone[:, _BEGIN])[np.bincount(numbers, minlength=m) > 0].max() + (around[:, :, _IN] - around[:, :, _BEGIN]).max(axis=1).sum()
        open_marks = ~((over < t["alone"]) & (over + follows < t["chained"])).all(axis=1)
        doubtful = [np.zeros(0, np.int64)]
        for a in range(0, n, PIECE_TOKENS):
            at = np.flatnonzero(open_marks[numbers[a:a + PIECE_TOKENS]]) + a
            if len(at):
                s, after = scores(at), scores(np.minimum(at + 1, n - 1))
                over = s[:, 1:] - s[:, :1]
                follows = after[:, _IN] - after[:, _BEGIN]  # what the next token gains as inside over begin
                follows[at == n - 1] = -np.inf
                certain = (over < t["alone"]) & (over + follows[:, None] < t["chained"])
                doubtful.append(at[~certain.all(axis=1)])
        at = np.concatenate(doubtful)
        if not len(at):
            return []
        tags = np.zeros(len(at), np.int64)
        starts = np.flatnonzero(np.diff(at, prepend=-2) > 1)
        ends = np.r_[starts[1:], len(at)]
        single = starts[(ends - starts == 1) & (at[starts] > 0) & (at[starts] < n - 1)]
        for a in range(0, len(single), PIECE_TOKENS):
            some = single[a:a + PIECE_TOKENS]
            tags[some] = (scores(at[some]) + self.steps[_OUT] + self.steps[:, _OUT]).argmax(axis=1)
        single = set(single.tolist())
        for a, b in zip(starts.tolist(), ends.tolist()):
            if a not in single:
                tags[a:b] = self._best(scores(at[a:b]), self.steps[_OUT] if at[a] else self.first, self.steps[:, _OUT] if at[b - 1] < n - 1 else np.zeros(3))
        out = [(p, tag) for p, tag in zip(at[tags != _OUT].tolist(), tags[tags != _OUT].tolist())]
        spans, k = [], 0
        for (first, a, b), end in zip(pieces, [*(p[0] for p in pieces[1:]), n]):
            if k < len(out) and out[k][0] < end:
                places = [m.span() for m in _TOKEN.finditer(text, a, b)]
                while k < len(out) and out[k][0] < end:
                    spans.append((out[k][1], *places[out[k][0] - first]))
                    k += 1
        return spans


def train(samples: Iterable[tuple[list[list[str]], list[int]]]) -> Field:
    """Conditional maximum likelihood by stochastic gradient steps; begin may not be
    left out before inside.  Samples are read once and kept as numbers, 4 bytes for each
    feature of a token; their names are kept once."""
    met: dict[str, int] = {}
    told, ends, tagged = array("i"), array("q", [0]), []
    for rows, tags in samples:
        for fs in rows:
            told.extend(met.setdefault(f, len(met)) for f in fs)
            ends.append(len(told))
        tagged.append((len(ends) - 1 - len(rows), tags))
    names = {f: n for n, f in enumerate(sorted(met))}
    codes = np.fromiter((names[f] for f in met), np.int32, len(met))[np.frombuffer(told, np.int32)]
    del met, told
    field = Field(names, np.zeros((len(names), 3)), np.zeros((3, 3)), np.zeros(3))
    field.steps[_OUT, _IN] = field.first[_IN] = -1e4
    allowed, allowed_first = field.steps > -1, field.first > -1
    rng = np.random.default_rng(4)
    for epoch in range(EPOCHS):
        rate = RATE / (1 + epoch)
        for k in rng.permutation(len(tagged)):
            first, tags = tagged[k]
            rows = [codes[ends[i]:ends[i + 1]] for i in range(first, first + len(tags))]
            score = np.array([field.weights[r].sum(axis=0) for r in rows])
            n = len(rows)
            ahead, behind = np.zeros((n, 3)), np.zeros((n, 3))
            ahead[0] = score[0] + field.first
            for i in range(1, n):
                ahead[i] = np.logaddexp.reduce(ahead[i - 1][:, None] + field.steps, axis=0) + score[i]
            for i in range(n - 2, -1, -1):
                behind[i] = np.logaddexp.reduce(field.steps + (score[i + 1] + behind[i + 1])[None, :], axis=1)
            whole = np.logaddexp.reduce(ahead[-1])
            p = np.exp(ahead + behind - whole)
            for i, r in enumerate(rows):
                change = -p[i]
                change[tags[i]] += 1
                field.weights[r] += rate * (change - SHRINK * field.weights[r])
            step = np.zeros((3, 3))
            for i in range(1, n):
                step -= np.exp(ahead[i - 1][:, None] + field.steps + (score[i] + behind[i])[None, :] - whole)
                step[tags[i - 1], tags[i]] += 1
            field.steps += rate * np.where(allowed, step, 0.0)
            start = -p[0]
            start[tags[0]] += 1
            field.first += rate * np.where(allowed_first, start, 0.0)
    return field


def _tagged(places: list[tuple[int, int]], secrets: list[tuple[int, int]]) -> list[int]:
    out, before = [], None
    for a, b in places:
        inside = next((s for s in secrets if s[0] < b and a < s[1]), None)
        out.append(_OUT if inside is None else _IN if inside == before else _BEGIN)
        before = inside
    return out


def _pieces(tags: list[int]) -> list[tuple[int, int]]:
    """Parts of a window of at most ``WINDOW_TOKENS``, cut before a secret rather than in it."""
    out, at = [], 0
    while len(tags) - at > WINDOW_TOKENS:
        cut = next((k for k in range(at + WINDOW_TOKENS, at, -1) if tags[k] != _IN), at + WINDOW_TOKENS)
        out.append((at, cut))
        at = cut
    return [*out, (at, len(tags))]


_KEYLIKE, _SECRET, _PLAIN = 0, 1, 2
Sample = tuple[str, list[str], list[int], list[str]]  # hash, tokens, tags, file features


def _samples(text: str) -> tuple[list[Sample], list[Sample], list[Sample]]:
    """A text's windows without and with a secret, the ``ROW_WINDOWS`` lowest by hash of
    each, and its piece of plain text."""
    found = windows(text)
    apart = plain(text, found)
    secrets = secret_places(text) if found else []
    if apart and not found:
        a, b = apart[1][0][0], apart[1][-1][1]
        secrets = [(a + x, a + y) for x, y in secret_places(text[a:b])]
    out: tuple[list[Sample], list[Sample], list[Sample]] = ([], [], [])
    for tokens, places, file in [*found, *([apart] if apart else [])]:
        tags = _tagged(places, secrets)
        for a, b in _pieces(tags):
            part = [_BEGIN if k == a and tags[k] == _IN else tags[k] for k in range(a, b)]
            key = blake2b("\0".join([*tokens[a:b], *map(str, part), *file]).encode("utf-8", "surrogatepass"), digest_size=12).hexdigest()
            out[_SECRET if any(part) else _PLAIN if apart and places is apart[1] else _KEYLIKE].append((key, tokens[a:b], part, file))
    return tuple(sorted({x[0]: x for x in side}.values())[:ROW_WINDOWS] for side in out)


def _lowest(windows: DataFrame, limit: int) -> list[Row]:
    """The ``limit`` rows of lowest key.  Counts by leading digits of the key (4096 at a
    time) bound it first, so that few more rows than ``limit`` are sorted or sent on,
    however many tasks hold them."""
    head, wanted = "", limit
    while len(head) < 24:
        counts = windows.where(F.col("key").startswith(head)).groupBy(F.substring("key", 1, len(head) + 3).alias("head")).count()
        for head, n in sorted(map(tuple, counts.collect())):
            if n >= wanted:
                break
            wanted -= n
        else:
            return windows.orderBy("key").collect()
        if n <= limit:
            break
    return windows.where(F.substring("key", 1, len(head)) <= head).orderBy("key").limit(limit).collect()


def fitted(spark: SparkSession, docs: DataFrame) -> Field | None:
    """The field, trained on a bounded sample of all documents' windows; None if no
    window holds a secret."""
    schema = "stratum int, key string, tokens array<string>, tags array<int>, file array<string>"

    def run(batches):
        kept: list[dict[str, Sample]] = [{}, {}, {}]
        for batch in slices(batches):
            for text in batch.column("text").to_pylist():
                for side, more in enumerate(_samples(text)):
                    kept[side].update((x[0], x) for x in more)
                    if len(kept[side]) > 2 * FIT_WINDOWS:
                        kept[side] = {k: kept[side][k] for k in sorted(kept[side])[:FIT_WINDOWS]}
        for side, named in enumerate(kept):
            rows = [named[k] for k in sorted(named)[:FIT_WINDOWS]]
            yield pa.RecordBatch.from_arrays([
                pa.array([side] * len(rows), pa.int32()), pa.array([x[0] for x in rows], pa.string()),
                pa.array([x[1] for x in rows], pa.list_(pa.string())), pa.array([x[2] for x in rows], pa.list_(pa.int32())),
                pa.array([x[3] for x in rows], pa.list_(pa.string()))], names=["stratum", "key", "tokens", "tags", "file"])

    ship_code(spark)
    made = stored(spark, texts(docs).select("text").mapInArrow(run, schema).dropDuplicates(["stratum", "key"]), "secret-windows")
    of = lambda stratum: made.where(F.col("stratum") == stratum)
    rows = _lowest(of(_SECRET), FIT_WINDOWS // 2)
    if not rows:
        return None
    rows += _lowest(of(_PLAIN), PLAIN_PIECES)
    rows += _lowest(of(_KEYLIKE), FIT_WINDOWS - len(rows))
    return train((features(r.tokens, r.file, named), list(r.tags)) for r in rows for named in (True, False)
                 if named or any(r.tags))


def all_spans(text: str, field: Field | None) -> list[Span]:
    spans = base_spans(text)
    if field is None:
        return spans
    more: list[Span] = []
    for tag, a, b in field.tagged(text):
        if tag == _IN:
            more[-1] = ("crf", more[-1][1], b)
        else:
            more.append(("crf", a, b))
    more = [s for s in more if not any(x[1] < s[2] and s[1] < x[2] for x in spans)]
    return sorted(spans + more, key=lambda s: (s[1], KINDS.index(s[0])))


def scanned(spark: SparkSession, docs: DataFrame, field: Field | None = None) -> DataFrame:
    """(doc_id, spans) for each row: spans are structs of kind, start and end."""
    field = field or fitted(spark, docs)

    def make():
        def work(batch):
            spans = [[{"kind": k, "start": a, "end": b} for k, a, b in all_spans(x, field)] for x in batch.column("text").to_pylist()]
            return {"doc_id": batch.column("doc_id"), "spans": spans}
        return work

    return map_texts(texts(docs), make, "doc_id long, spans array<struct<kind:string,start:int,end:int>>")


def masked(text: str, spans: list[Span], mask: str) -> str:
    out, at = [], 0
    for _, a, b in spans:
        if b > at:
            out += [text[at:a], mask] if a >= at else []
            at = b
    return "".join([*out, text[at:]])


def without_secrets(spark: SparkSession, docs: DataFrame, mask: str = "<secret>") -> DataFrame:
    """``docs``, all rows and columns, with every span in ``text`` replaced by the mask
    (spans that overlap by one) and, where there is one, ``n_chars`` counted again.
    Null texts stay null."""
    field = fitted(spark, docs)
    at = docs.columns.index("text")

    def clean(batches):
        for batch in slices(batches):
            made = [None if x is None else masked(x, all_spans(x, field), mask) for x in batch.column(at).to_pylist()]
            columns = list(batch.columns)
            columns[at] = pa.array(made, batch.schema.field(at).type)
            yield pa.RecordBatch.from_arrays(columns, schema=batch.schema)

    ship_code(spark)
    out = docs.mapInArrow(clean, docs.schema)
    if "n_chars" not in docs.columns:
        return out
    counted = F.when(F.col("text").isNull(), F.col("n_chars")).otherwise(F.char_length("text"))
    return out.withColumn("n_chars", counted.cast(docs.schema["n_chars"].dataType))


def joined(base_only: bool) -> Column:
    chosen = F.filter("spans", lambda s: s["kind"] != F.lit("crf")) if base_only else F.col("spans")
    return F.array_join(F.transform(chosen, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def op4_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secret spans of every document."""
    found = scanned(spark, read_table(spark, sf_dir, "documents"))
    counts = [F.size(F.expr(f"filter(spans, s -> s.kind = '{k}')")).cast("long").alias(f"n_{k}") for k in KINDS]
    return found.select("doc_id", *counts[:3], F.sha2(joined(True).cast("binary"), 256).alias("base_sha256"),
                        joined(False).alias("spans"), counts[3])
