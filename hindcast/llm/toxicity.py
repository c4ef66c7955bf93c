"""Operator 1, toxicity: a lexicon learned from labels, matched through Levenshtein
automata over its trie, with hits weighed by the window around them.

Learning, on at most ``FIT_ROWS`` labelled rows outside the held-out fold:
1. Words and word stems (prefixes) get their log odds in toxic texts.  A term must be
   more frequent there than chance gives any of the sample's terms, rare in others, and
   stand in many different contexts, so that words of one text with many near copies
   don't count.  From a family of prefixes the longest stays that loses no support.
2. Spellings near a term that clean texts hold are words of their own and are set
   aside.  A logistic function of a text's hits is then fitted on another fold.

Scoring: the trie and the automata of all terms run as one machine whose states are
made when first met (a state is the set of trie nodes with the edits used so far), so
a word costs a table look-up per character, and a word met before one look-up in all.
Terms of five characters allow one edit, of eight two; digits and signs that stand
for letters are read as letters.  A hit inside a quotation, however long, counts less,
one beside a word of address or beside other hits more.

Rows: null and empty texts have no hits and the score of a text without hits; without
labels, or without toxic ones, no term is learned and all texts score alike; repeated
rows get equal results; an empty table gives no rows; columns other than ``doc_id``
and ``text`` are ignored, and labels, language, source and ids are no input of a score.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections import Counter, defaultdict
from math import exp, log, log1p

import numpy as np
from pyspark.sql import DataFrame, SparkSession, functions as F

from hindcast.llm.common import held_out, labelled, map_texts, ship_code, stored, texts
from hindcast.sources.tables import read_table

FIT_ROWS = 16_000
SUPPORT, LEAST_LOG_ODDS, CONTEXT_SHARE = 3, 3.8, 0.5
#: Chance that any term of the sample is learned though texts hold it at random.
FALSE_TERM = 0.01
STEM_LENGTHS = range(4, 9)
#: Share of a stem's support that a longer one must keep.
SAME_SUPPORT = 0.9
EDITS_BY_LENGTH = [(8, 2), (5, 1)]
STEM_EDITS_FROM = 7
NEAR_SPELLING = 0.6
QUOTED, ADDRESSED, CROWDED = -0.6, 0.1, 0.1
WINDOW_WORDS = 6
WORDS_KEPT = 700_000
THRESHOLD = 0.3
#: Bias and weights of strongest exact hit, strongest near hit and the sum of hits.
PRIOR, PRIOR_STRENGTH = np.array([-4.0, 1.0, 0.8, 0.5]), 1.0

_WORD = re.compile(r"[\w@$]+")
_LETTERS = str.maketrans("013457@$8", "oieastasb")
_DISGUISE = re.compile(r"[013457@$8]")
_MARK = re.compile("[\"“”„«»‹›‘’]")
# Marks that end a quotation, by the one that begins it.
_ENDS = {'"': '"', "“": "”", "„": "“”", "«": "»", "»": "«", "‹": "›", "›": "‹", "‘": "’"}
# Words of address in the corpus's languages.
_ADDRESS = set("you your youre ur du dich dir ihr euch dein tu te toi vous votre usted ustedes vosotros eres".split())


def words_of(text: str) -> list[str]:
    return _WORD.findall(text.lower())


def quotations(text: str) -> list[tuple[int, int]]:
    """The outermost quotations of a whole text, from behind the mark that begins one to
    the mark that ends it, in order and apart.

    A mark begins a quotation where no word ends before it and something follows at once,
    and ends one where no space stands before it and no word goes on behind it (so inches
    and apostrophes do neither).  If the same mark begins again before an end came, the
    earlier one was a stray and quotes nothing, as does one that no mark ends."""
    found, start, mark = [], 0, ""
    for m in _MARK.finditer(text):
        c, at = m.group(), m.start()
        before, after = text[at - 1:at] or " ", text[at + 1:at + 2] or " "
        if mark and c in _ENDS[mark] and not before.isspace() and not after.isalnum():
            found.append((start, at))
            mark = ""
        elif (not mark or c == mark) and c in _ENDS and not before.isalnum() and not after.isspace():
            start, mark = at + 1, c
    return found


def folded(word: str) -> str:
    return word.translate(_LETTERS) if _DISGUISE.search(word) and not word.isdigit() else word


class Lexicon:
    """Terms with weights; a term that ends in ``*`` is a stem."""

    def __init__(self, weights: dict[str, float], own_words: set[str] = frozenset()):
        self.weights, self.own_words = weights, own_words
        self.children: list[dict[str, int]] = [{}]
        self.word: list[str | None] = [None]
        self.stem: list[str | None] = [None]
        self.reach = [0]
        for term in sorted(weights):
            at, edits = 0, self.edits(term)
            self.reach[0] = max(self.reach[0], edits)
            for c in term.rstrip("*"):
                if c not in self.children[at]:
                    self.children[at][c] = len(self.children)
                    self.children.append({})
                    self.word.append(None)
                    self.stem.append(None)
                    self.reach.append(0)
                at = self.children[at][c]
                self.reach[at] = max(self.reach[at], edits)
            (self.stem if term.endswith("*") else self.word)[at] = term
        self.letters = {c for x in self.children for c in x}
        self.ids: dict[tuple, int] = {}
        self.states: list[tuple] = []
        self.next: list[dict[str, int]] = []
        self.begin = self._state({0: 0}, None)
        self.known: dict[str, tuple[str, int] | int] = {}

    @staticmethod
    def edits(term: str) -> int:
        n = len(term.rstrip("*"))
        if term.endswith("*"):
            return int(n >= STEM_EDITS_FROM)
        return next((e for least, e in EDITS_BY_LENGTH if n >= least), 0)

    def _state(self, nodes: dict[int, int], stem: tuple[int, str] | None) -> int:
        """The number of a state: trie nodes with edits used, closed under skipped
        letters, and the best stem passed."""
        todo = list(nodes)
        while todo:
            at = todo.pop()
            for child in self.children[at].values():
                e = nodes[at] + 1
                if e <= self.reach[child] and e < nodes.get(child, 99):
                    nodes[child] = e
                    todo.append(child)
        for at, e in nodes.items():
            term = self.stem[at]
            if term and e <= self.edits(term) and (stem is None or e < stem[0]):
                stem = (e, term)
        key = (frozenset(nodes.items()), stem)
        if key not in self.ids:
            self.ids[key] = len(self.states)
            self.states.append(key)
            self.next.append({})
        return self.ids[key]

    def _step(self, state: int, c: str) -> int:
        nodes, stem = self.states[state]
        after: dict[int, int] = {}
        for at, e in nodes:
            if e + 1 <= self.reach[at]:
                after[at] = min(after.get(at, 99), e + 1)
            for letter, child in self.children[at].items():
                cost = e + (letter != c)
                if cost <= self.reach[child]:
                    after[child] = min(after.get(child, 99), cost)
        return self._state(after, stem)

    def match(self, word: str) -> tuple[str, int] | int:
        """(term, edits) of the nearest term, or 0."""
        known = self.known.get(word)
        if known is not None:
            return known
        state = self.begin
        for c in folded(word):
            c = c if c in self.letters else ""
            following = self.next[state].get(c)
            if following is None:
                following = self.next[state][c] = self._step(state, c)
            state = following
            if not self.states[state][0] and self.states[state][1] is None:
                break
        nodes, stem = self.states[state]
        found = [(e, self.word[at]) for at, e in nodes if self.word[at] and e <= self.edits(self.word[at])]
        best = min([*found, *([stem] if stem else [])], default=None, key=lambda x: (x[0], -self.weights[x[1]], x[1]))
        out = 0 if best is None or best[0] and word in self.own_words else (best[1], best[0])
        if len(self.known) >= WORDS_KEPT:
            self.known.clear()
        if len(word) <= 40:
            self.known[word] = out
        return out

    def hits(self, text: str) -> list[tuple[str, str, int, float]]:
        """(word, term, edits, weight in its window) of every hit."""
        words = words_of(text)
        matches = list(map(self.known.get, words))
        if None in matches:
            matches = list(map(self.match, words))
        if not any(matches):
            return []
        low = text.lower()
        hit_at = [n for n, m in enumerate(matches) if m]
        found, places = [], [m.span() for m in _WORD.finditer(low)]
        quoted_from, quoted_to = zip(*quotations(low) or [(len(low), len(low))])
        for n in hit_at:
            term, edits = matches[n]
            a, b = places[n]
            k = bisect_right(quoted_from, a) - 1
            quoted = k >= 0 and b <= quoted_to[k]
            around = words[max(0, n - WINDOW_WORDS):n + WINDOW_WORDS + 1]
            crowd = min(sum(bool(m) for m in matches[max(0, n - WINDOW_WORDS):n + WINDOW_WORDS + 1]) - 1, 3)
            context = 1 + QUOTED * quoted + ADDRESSED * any(w in _ADDRESS for w in around) + CROWDED * crowd
            found.append((words[n], term, edits, self.weights[term] * context * (NEAR_SPELLING ** edits)))
        return found


def features(hits: list[tuple[str, str, int, float]]) -> list[float]:
    exact = max((w for _, _, e, w in hits if not e), default=0.0)
    near = max((w for _, _, e, w in hits if e), default=0.0)
    return [1.0, exact, near, log1p(sum(w for *_, w in hits))]


def surprise(toxic: int, clean: int, rate: float) -> float:
    """A lower bound of -log of the chance that at least ``toxic`` of the texts that hold
    a term are toxic if each is so at ``rate`` (Chernoff)."""
    n = toxic + clean
    share = toxic / n
    if share <= rate or rate >= 1:
        return 0.0
    return toxic * log(share / rate) + (clean * log((1 - share) / (1 - rate)) if clean else 0.0)


def terms_of(text: str) -> set[str]:
    """The words of a text and their stems."""
    words = {w for w in set(words_of(text)) if 3 <= len(w) <= 24 and w.isalpha()}
    return words | {w[:k] + "*" for w in words for k in STEM_LENGTHS if k < len(w)}


def _counts(sample: DataFrame, wanted: frozenset[str] | None) -> DataFrame:
    """(term, toxic, clean) texts of the sample by term, summed within tasks first."""

    def run(batches):
        import pyarrow as pa

        seen = [Counter(), Counter()]
        for batch in batches:
            for label, text in zip(batch.column("label").to_pylist(), batch.column("text").to_pylist()):
                terms = terms_of(text)
                seen[label].update(terms if wanted is None else terms & wanted)
        terms = list(set(seen[0]) | set(seen[1]))
        yield pa.RecordBatch.from_arrays([pa.array(terms, pa.string()), pa.array([seen[1][t] for t in terms], pa.int64()),
                                          pa.array([seen[0][t] for t in terms], pa.int64())], names=["term", "toxic", "clean"])

    ship_code(sample.sparkSession)
    made = sample.select("label", "text").mapInArrow(run, "term string, toxic long, clean long")
    return made.groupBy("term").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))


def _contexts(sample: DataFrame, wanted: frozenset[str]) -> DataFrame:
    """(term, contexts): distinct pairs of neighbours of a term in toxic texts."""

    def make():
        def work(batch):
            found = set()
            for text in batch.column("text").to_pylist():
                words = words_of(text)
                for n, w in enumerate(words):
                    own = [t for t in (w, *(w[:k] + "*" for k in STEM_LENGTHS if k < len(w))) if t in wanted]
                    if own:
                        pair = " ".join([*words[max(0, n - 1):n], "_", *words[n + 1:n + 2]])
                        found.update((t, pair) for t in own)
            return {"term": [t for t, _ in found], "pair": [p for _, p in found]}
        return work

    made = map_texts(sample.where("label = 1").select("text"), make, "term string, pair string")
    return made.distinct().groupBy("term").agg(F.count(F.lit(1)).alias("contexts"))


def chosen_terms(odds: dict[str, float], support: dict[str, int]) -> dict[str, float]:
    """One term for each family: from the shortest stem down to the longest stem or
    word that keeps its support; other members of the family if they stand apart."""
    out: dict[str, float] = {}
    families = defaultdict(list)
    for t in odds:
        families[t.rstrip("*")[:STEM_LENGTHS[0]] if len(t.rstrip("*")) >= STEM_LENGTHS[0] else t].append(t)
    for members in families.values():
        left = sorted(members, key=lambda t: (-support[t], len(t.rstrip("*")), t))
        while left:
            top = support[left[0]]
            near = [t for t in left if support[t] >= SAME_SUPPORT * top]
            term = max(near, key=lambda t: (len(t.rstrip("*")), not t.endswith("*"), t))
            out[term] = odds[term]
            body = term.rstrip("*")
            left = [t for t in left if not (body.startswith(t.rstrip("*")) or term.endswith("*") and t.startswith(body))]
    return out


class Model:
    def __init__(self, lexicon: Lexicon, weights: np.ndarray):
        self.lexicon, self.weights = lexicon, weights

    def score(self, text: str) -> float:
        z = float(np.dot(self.weights, features(self.lexicon.hits(text))))
        return 1 / (1 + exp(-z)) if z > -700 else 0.0


def logistic(x: np.ndarray, y: np.ndarray, prior: np.ndarray, strength: float) -> np.ndarray:
    """Logistic weights by Newton steps, drawn to ``prior``.  But for the bias none is
    negative, as a hit is no sign of a clean text: the least one below 0 becomes 0 and
    the rest are found again."""
    free = np.ones(len(prior), bool)
    while True:
        w, own = np.where(free, prior, 0.0), x[:, free]
        for _ in range(50):
            p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
            slope = own.T @ (p - y) + strength * (w - prior)[free]
            bend = (own * (p * (1 - p))[:, None]).T @ own + strength * np.eye(own.shape[1])
            step = np.linalg.solve(bend, slope)
            w[free] -= np.clip(step, -1, 1)
            if np.abs(step).max() < 1e-6:
                break
        least = 1 + int(np.argmin(w[1:]))
        if w[least] >= 0:
            return w
        free[least] = False


def fitted(spark: SparkSession, docs: DataFrame, labels: DataFrame, limit: int = FIT_ROWS) -> Model:
    """The model; everything that reaches the driver is bounded by ``limit`` rows."""
    sample = stored(spark, labelled(spark, docs, labels, "toxic", limit), "toxicity-sample")
    by_label = {r.label: r.n for r in sample.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}
    n_toxic, n_clean = by_label.get(1, 0), by_label.get(0, 0)
    if not n_toxic:
        return Model(Lexicon({}), np.array([log(0.5 / (n_clean + 1)), 0, 0, 0]))
    frequent = _counts(sample.where("label = 1"), None).where(F.col("toxic") >= SUPPORT)
    wanted = frozenset(r.term for r in frequent.select("term").collect())
    odds, support, rate = {}, {}, n_toxic / max(n_toxic + n_clean, 1)
    for r in _counts(sample, wanted).collect():
        o = log((r.toxic + 0.5) / (n_toxic + 1)) - log((r.clean + 0.5) / (n_clean + 1))
        if o >= LEAST_LOG_ODDS and surprise(r.toxic, r.clean, rate) >= log(len(wanted) / FALSE_TERM):
            odds[r.term], support[r.term] = o, r.toxic
    varied = {r.term for r in _contexts(sample, frozenset(odds)).collect() if r.contexts >= max(SUPPORT, CONTEXT_SHARE * support[r.term])}
    weights = chosen_terms({t: odds[t] for t in varied}, support)

    lexicon = Lexicon(weights)
    if not weights:
        return Model(lexicon, np.array([log((n_toxic + 0.5) / (n_clean + 1)), 0, 0, 0]))

    def make_near():
        def work(batch):
            near = [sorted({w for w, _, e, _ in lexicon.hits(x) if e}) for x in batch.column("text").to_pylist()]
            return {"near": near}
        return work

    clean = sample.where("label = 0 and fold != 3").select("text")
    own = map_texts(clean, make_near, "near array<string>").select(F.explode("near").alias("word")).distinct()
    ready = Lexicon(weights, {r.word for r in own.collect()})

    def make_features():
        def work(batch):
            return {"label": batch.column("label"), "x": [features(ready.hits(x)) for x in batch.column("text").to_pylist()]}
        return work

    rows = map_texts(sample.where("fold = 3").select("label", "text"), make_features, "label int, x array<double>").collect()
    if not rows:
        return Model(ready, PRIOR)
    x, y = np.array([r.x for r in rows]), np.array([r.label for r in rows], float)
    return Model(ready, logistic(x, y, PRIOR, PRIOR_STRENGTH))


def scored(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, score, hits) for each row: hits are structs of word, term, edits and
    weight."""

    def make():
        def work(batch):
            out, hits = [], []
            for text in batch.column("text").to_pylist():
                found = model.lexicon.hits(text)
                z = float(np.dot(model.weights, features(found)))
                out.append(1 / (1 + exp(-max(z, -700.0))))
                hits.append([{"word": w, "term": t, "edits": e, "weight": v} for w, t, e, v in found])
            return {"doc_id": batch.column("doc_id"), "score": out, "hits": hits}
        return work

    return map_texts(texts(docs), make, "doc_id long, score double, hits array<struct<word:string,term:string,edits:int,weight:double>>")


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of every document."""
    docs = read_table(spark, sf_dir, "documents")
    made = scored(docs, fitted(spark, docs, read_table(spark, sf_dir, "labels")))
    return made.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score",
                       (F.col("score") >= THRESHOLD).cast("int").alias("predicted"), F.size("hits").alias("n_hits"))
