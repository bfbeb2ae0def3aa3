"""Toxicity: a learned lexicon, met by Levenshtein automata, and weighed by context.

The lexicon holds words and stems that labelled toxic texts have and clean ones
lack.  It is kept as a trie; the Levenshtein automaton of a word walks the trie,
so a misspelled term is found without comparing it with each entry.  Words
around a hit tell abuse (second person, exclamation) from quotation (quotes and
verbs of reporting).  A logistic regression over the few sums scores the text.
"""

from __future__ import annotations

import math
import pickle
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .quality import fit_labelled, held_out, scorer

#: Labelled rows the fit takes at most, those of the smallest hashes of doc_id.
FIT_ROWS = 6000
#: Texts that must have a term or stem, and how many times likelier toxic ones must have it.
LEAST_TEXTS, LEAST_RATIO = 5, 12.0
STEM = range(4, 9)
#: Entries of so many letters that this share of the labelled toxic texts have, or so many of them, are also met with edits, by words of so many letters.
FUZZY_ENTRY, FUZZY_TOXIC, FUZZY_TEXTS, FUZZY_LENGTH, EDITS = 4, 0.05, 20, 3, 1
#: A misspelled hit counts as this share of its entry.
FUZZY_SHARE = 0.8
FEATURES = 6
WINDOW = 8
CACHE_WORDS = 400_000

_WORD = re.compile(r"[^\W\d_]+")
_REPORTING = set("said says wrote writes called calls quote quoted quotes reported dit disait écrit cite cité sagte schrieb nannte zitat zitiert dijo escribió llamó cita citó".split())
_ADDRESS = set("you your youre u ya du dich dir dein ihr euch tu toi te vous votre eres tú usted ustedes vosotros".split())
_QUOTES = re.compile("[\"“”„«»‹›]")


class LevenshteinAutomaton:
    """Accepts the strings within ``edits`` of a word; a state is one bit set of places for each number of edits."""

    def __init__(self, word: str, edits: int):
        self.full = 1 << len(word)
        self.all = 2 * self.full - 1
        self.edits = edits
        self.masks: dict[str, int] = {}
        for k, c in enumerate(word):
            self.masks[c] = self.masks.get(c, 0) | 1 << k
        state, out = 1, []
        for _ in range(edits + 1):
            out.append(state)
            state |= state << 1
        self.start = tuple(out)

    def step(self, state: tuple[int, ...], char: str) -> tuple[int, ...]:
        mask, out, below_old, below_new = self.masks.get(char, 0), [], 0, 0
        for old in state:
            new = (old & mask) << 1 | below_old | below_old << 1 | below_new << 1
            below_old, below_new = old, new & self.all
            out.append(below_new)
        return tuple(out)

    def accepts(self, state: tuple[int, ...]) -> int | None:
        """The fewest edits, if the state accepts."""
        return next((e for e, s in enumerate(state) if s & self.full), None)


class LexiconTrie:
    """Entries (whole words, or stems that any ending may follow) with weights."""

    def __init__(self, words: dict[str, float], stems: dict[str, float], firm: frozenset[str], plain: frozenset[str] = frozenset()):
        self.words, self.stems, self.plain = words, stems, plain
        self.root: dict = {}
        long = [w for w in words if len(w) >= FUZZY_ENTRY and w in firm]
        for entry in long:
            node = self.root
            for c in entry:
                node = node.setdefault(c, {})
            node[""] = entry
        # one edit leaves the first or the last half of an entry as it was
        self.heads = {w[: len(w) // 2] for w in long}
        self.tails = {w[len(w) // 2 :] for w in long}
        self.head_sizes = sorted({len(h) for h in self.heads})
        self.tail_sizes = sorted({len(t) for t in self.tails})
        self.stem_sizes = sorted({len(s) for s in stems})
        self.sizes = range(FUZZY_LENGTH, max(map(len, long), default=0) + EDITS + 1)

    def find(self, word: str) -> tuple[str, float] | None:
        """(kind, weight) of a lower-cased word: exact, stem or fuzzy."""
        if (weight := self.words.get(word)) is not None:
            return "exact", weight
        for n in self.stem_sizes:
            if (weight := self.stems.get(word[:n])) is not None and len(word) >= n:
                return "stem", weight
        if len(word) not in self.sizes or not (any(word[:n] in self.heads for n in self.head_sizes) or any(word[-n:] in self.tails for n in self.tail_sizes)):
            return None
        if word in self.plain:
            return None
        entry = self.near(word)
        return entry and ("fuzzy", FUZZY_SHARE * self.words[entry])

    def near(self, word: str, edits: int = EDITS) -> str | None:
        """The entry of fewest edits from ``word``, of those within ``edits``; ties go to the first in order."""
        automaton = LevenshteinAutomaton(word, edits)
        todo, best = [(self.root, automaton.start)], None
        while todo:
            node, state = todo.pop()
            for c, child in node.items():
                if c == "":
                    if (e := automaton.accepts(state)) is not None and (best is None or (e, child) < best):
                        best = e, child
                elif any(after := automaton.step(state, c)):
                    todo.append((child, after))
        return best and best[1]


class ToxicityModel:
    """Lexicon, weights and the scorer; plain data, so executors get it whole.

    ``firm`` holds the entries met with edits too, ``plain`` ordinary words that
    happen to be near one.
    """

    def __init__(self, words: dict[str, float], stems: dict[str, float], firm: frozenset[str], plain: frozenset[str] = frozenset()):
        self.words, self.stems, self.firm, self.plain = words, stems, firm, plain
        self.weights = np.zeros(FEATURES)
        self._ready = None

    def __getstate__(self):
        return self.words, self.stems, self.firm, self.plain, self.weights

    def __setstate__(self, state):
        self.words, self.stems, self.firm, self.plain, self.weights = state
        self._ready = None

    def hits(self, text: str) -> list[tuple[int, str, float]]:
        """(start, kind, weight) of the lexicon's hits in a text."""
        if self._ready is None or len(self._ready[1]) > CACHE_WORDS:
            self._ready = LexiconTrie(self.words, self.stems, self.firm, self.plain), {}
        trie, cache = self._ready
        low = text.lower()
        found = set(_WORD.findall(low))
        for w in found.difference(cache):
            cache[w] = trie.find(w)
        found = {w: cache[w] for w in found if cache[w]}
        return [(m.start(), *found[m[0]]) for m in _WORD.finditer(low) if m[0] in found] if found else []

    def features(self, text: str) -> np.ndarray:
        out = np.zeros(FEATURES)
        out[5] = 1
        if hits := self.hits(text):
            low = text.lower()
            for start, kind, weight in hits:
                before, after = low[max(0, start - 8 * WINDOW) : start], low[start : start + 8 * WINDOW]
                near = [*_WORD.findall(before)[-WINDOW:], *_WORD.findall(after)[1 : WINDOW + 1]]
                quoted = (len(_QUOTES.findall(before)) % 2 == 1 and _QUOTES.search(after) is not None) + any(w in _REPORTING for w in near)
                abuse = any(w in _ADDRESS for w in near) + ("!" in after[:24])
                out[kind == "stem"] += weight
                out[2] += quoted > 0
                out[3] += abuse > 0
            out[:4] = np.log1p(out[:4])
            out[4] = min(1.0, sum(w for _, _, w in hits) / 6)
        return out

    def scores(self, texts: list[str]) -> np.ndarray:
        x = np.array([self.features(t) for t in texts]).reshape(-1, FEATURES) @ self.weights
        return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def _ratios(texts: list[set[str]], labels: np.ndarray) -> dict[str, tuple[int, float]]:
    toxic, clean = Counter(), Counter()
    for terms, y in zip(texts, labels, strict=True):
        (toxic if y else clean).update(terms)
    n, m = max(1, labels.sum()), max(1, (1 - labels).sum())
    return {t: (a, (a + 0.5) / (n + 1) / ((clean[t] + 0.5) / (m + 1))) for t, a in toxic.items() if a >= LEAST_TEXTS}


def fit(texts: list[str], labels: np.ndarray) -> ToxicityModel:
    """Lexicon and weights of labelled texts (1: toxic)."""
    words = [set(_WORD.findall(t.lower())) for t in texts]
    ratios = _ratios(words, labels)
    lexicon = {t: math.log(r) for t, (_, r) in ratios.items() if r >= LEAST_RATIO and len(t) >= 3}
    # stems: short openings of words outside the lexicon, the shortest that tells
    openings = [{w[:n] for w in own if w not in lexicon for n in STEM if len(w) > n} for own in words]
    stems: dict[str, float] = {}
    for stem, (a, r) in sorted(_ratios(openings, labels).items(), key=lambda x: (len(x[0]), x[0])):
        if a >= 2 * LEAST_TEXTS and r >= LEAST_RATIO and not any(stem[:n] in stems for n in STEM):
            stems[stem] = math.log(r)
    lexicon = {w: v for w, v in lexicon.items() if not any(w[:n] in stems for n in STEM)}
    firm = frozenset(w for w in lexicon if ratios[w][0] >= min(FUZZY_TEXTS, FUZZY_TOXIC * labels.sum()))
    trie = LexiconTrie(lexicon, stems, firm)
    clean = set().union(*(own for own, y in zip(words, labels, strict=True) if not y))
    model = ToxicityModel(lexicon, stems, firm, frozenset(w for w in clean if (hit := trie.find(w)) and hit[0] == "fuzzy"))
    if len(texts):
        x = np.array([model.features(t) for t in texts])
        w = np.zeros(FEATURES)
        for _ in range(30):  # Newton steps of ridge logistic regression
            p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
            h = (x * (p * (1 - p))[:, None]).T @ x + 0.1 * np.eye(FEATURES)
            w -= np.linalg.solve(h, x.T @ (p - labels) + 0.1 * w)
        model.weights = w
    return model


def _score(column: pa.Array, model: ToxicityModel) -> np.ndarray:
    return model.scores([t or "" for t in column.to_pylist()])


def train(docs: DataFrame, labels: DataFrame, most: int = FIT_ROWS) -> ToxicityModel:
    """Fits on at most ``most`` rows of ``labels`` (doc_id, toxic) outside the held-out fold; without any, every score is 0.5."""
    return pickle.loads(fit_labelled(docs, labels, "toxic", most, lambda texts, y: pickle.dumps(fit(texts, y))))


def toxicity(docs: DataFrame, model: ToxicityModel, text: str = "text") -> Column:
    return scorer(docs, model, _score)(F.col(text).cast("string"))


def toxicity_scores(docs: DataFrame, labels: DataFrame, threshold: float = 0.5) -> DataFrame:
    """One row for each row of ``docs`` (doc_id, text): doc_id, held_out, score, predicted.

    Null texts count as empty and score as such; a null doc_id is not held out;
    labels without id or value are left out, and of several of one id the largest
    counts.  Repeated rows score alike; an empty table gives an empty result;
    other columns are ignored.
    """
    model = train(docs, labels)
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").withColumn("score", toxicity(docs, model))
    return own.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def explain(docs: DataFrame, model: ToxicityModel) -> DataFrame:
    """(doc_id, start, kind, weight) of every hit of the lexicon, in code points."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [(d, *h) for d, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True) for h in sent.value.hits(t or "")]
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate((pa.int64(), pa.int64(), pa.string(), pa.float64()))], ["doc_id", "start", "kind", "weight"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, start long, kind string, weight double")
