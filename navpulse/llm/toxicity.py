"""Toxicity scores from a learned lexicon, misspellings included.

The lexicon is learned from labelled rows: words, and beginnings of words, that toxic texts
hold far more often than others. It becomes a trie, and the words of a text are run through
the product of the trie and a Levenshtein automaton of one edit. The product is built as a
deterministic automaton, a state when it is first reached, so a word costs one look-up a
character and leaves as soon as no term is near. Beginnings must match without an edit;
whole terms of at least ``FUZZY`` letters may have one (id1ot, stuppid).

Each hit is judged in its window: inside quotation marks or shortly after a word of
reporting it counts as quoted, close to a word of address as abuse of somebody. A logistic
model over the counts by kind gives the score. Misspellings have a prior of four
fifths of the weight of exact hits, from which the labels may move them.

What is learned comes from at most ``max_rows`` labelled rows (those with the smallest hash
of their id), none of them held out; the lexicon has at most ``max_terms`` entries. Both
are small and travel with the tasks. Every row is scored on its whole text, and nothing
but the text enters a score.

Null and empty texts get the score of a text without hits. Labels that are null, or of ids
that have no document, are ignored. Without labels all scores are 0; with labels of one
kind only, their mean. Repeated rows are scored each; an empty table gives no rows.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from navpulse.llm.common import byte_slices, free_name, freeze, map_batches, schema_of, texts

WORDS = re.compile(r"[^\W_](?:[^\W_]|[@$*](?=[^\W_]))*")
#: Terms of fewer letters must match exactly.
FUZZY = 5
STEMS = range(3, 8)
EXACT, STEM, NEAR = 1, 2, 3
#: Words of reporting and of address, and quotation marks by opening mark.
REPORTING = frozenset("said says say called calls word words term quote quoted quoting wrote meaning".split())
ADDRESS = frozenset("you your you're u he she they him her them".split())
QUOTES = {'"': '"', "“": "”", "«": "»", "„": "“", "‘": "’"}
FEATURES = ("exact", "near", "stem", "stem_rate", "quoted", "addressed")


@dataclass
class Lexicon:
    """Trie of terms, and the deterministic product with the automaton of one edit."""

    words: list[str]
    stems: list[str]
    edits: int = 1
    children: list[dict[str, int]] = field(default_factory=lambda: [{}])
    ends: dict[int, int] = field(default_factory=dict)  # node: length of the whole term
    stem_ends: set[int] = field(default_factory=set)

    def __post_init__(self):
        for term in self.words:
            self.ends[self.insert(term)] = len(term)
        for term in self.stems:
            self.stem_ends.add(self.insert(term))
        self.states: dict[frozenset, int] = {}
        self.sets: list[frozenset] = []
        self.next: list[dict[str, int]] = []
        self.accepts: list[int] = []
        self.stem_here: list[bool] = []
        self.start = self.state(self.closure({(0, 0)}))
        self.known: dict[str, int] = {}

    def insert(self, term: str) -> int:
        node = 0
        for c in term:
            if c not in self.children[node]:
                self.children[node][c] = len(self.children)
                self.children.append({})
            node = self.children[node][c]
        return node

    def closure(self, positions: set[tuple[int, int]]) -> frozenset:
        """With letters of the term left out; of a node only the fewest edits matter."""
        least: dict[int, int] = {}
        todo = list(positions)
        while todo:
            node, e = todo.pop()
            if least.get(node, self.edits + 1) <= e:
                continue
            least[node] = e
            if e < self.edits:
                todo += [(child, e + 1) for child in self.children[node].values()]
        return frozenset(least.items())

    def state(self, positions: frozenset) -> int:
        if positions not in self.states:
            self.states[positions] = len(self.sets)
            self.sets.append(positions)
            self.next.append({})
            kinds = [EXACT if e == 0 else NEAR for node, e in positions if self.ends.get(node, 0) >= (FUZZY if e else 1)]
            self.accepts.append(min(kinds, default=0))
            self.stem_here.append(any(e == 0 and node in self.stem_ends for node, e in positions))
        return self.states[positions]

    def step(self, state: int, c: str) -> int:
        """The state after ``c``: it is the term's letter, another one's place, or too much."""
        moved = set()
        for node, e in self.sets[state]:
            for letter, child in self.children[node].items():
                if letter == c:
                    moved.add((child, e))
                elif e < self.edits:
                    moved.add((child, e + 1))
            if e < self.edits:
                moved.add((node, e + 1))
        self.next[state][c] = made = self.state(self.closure(moved)) if moved else -1
        return made

    def kind(self, word: str) -> int:
        state, stem = self.start, False
        for c in word:
            after = self.next[state].get(c)
            state = self.step(state, c) if after is None else after
            if state < 0:
                return STEM if stem else 0
            stem = stem or self.stem_here[state]
        found = self.accepts[state]
        return found if found == EXACT else STEM if stem else found

    def kinds(self, words: set[str]) -> dict[str, int]:
        if len(self.known) > 1_000_000:
            self.known.clear()
        for w in words.difference(self.known):
            self.known[w] = self.kind(w)
        return self.known


def in_window(text: str, start: int, end: int, window: int = 60) -> tuple[bool, bool]:
    """Is the hit quoted; is somebody addressed near it?"""
    before, after = text[max(0, start - window) : start], text[end : end + window]
    quoted = False
    for mark, close in QUOTES.items():
        if mark == close:
            quoted |= before.count(mark) % 2 == 1 and close in after
        else:
            quoted |= before.rfind(mark) > before.rfind(close) and close in after
    near = WORDS.findall(before)[-3:]
    quoted |= any(w in REPORTING for w in near)
    return quoted, any(w in ADDRESS for w in near + WORDS.findall(after)[:3])


def features(text: str, lexicon: Lexicon) -> list[float]:
    low = text.lower()
    words = WORDS.findall(low)
    known = lexicon.kinds(set(words))
    if not any(map(known.__getitem__, words)):
        return [0.0] * len(FEATURES)
    counts = Counter()
    for m in WORDS.finditer(low):
        if kind := known[m[0]]:
            quoted, addressed = in_window(low, m.start(), m.end())
            counts["quoted" if quoted else kind] += 1
            counts["addressed"] += addressed and not quoted
    rate = 100 * counts[STEM] / len(words)
    return [math.log1p(x) for x in (counts[EXACT], counts[NEAR], counts[STEM], rate, counts["quoted"], counts["addressed"])]


@dataclass
class Model:
    words: list[str]
    stems: list[str]
    weights: list[float]  # of the constant, then of FEATURES
    constant: float | None = None

    def score(self, x: list[float]) -> float:
        if self.constant is not None:
            return self.constant
        z = self.weights[0] + sum(w * v for w, v in zip(self.weights[1:], x))
        return 1 / (1 + math.exp(-max(-60.0, min(60.0, z))))


def held_out(doc_id: str = "doc_id"):
    """Rows whose labels are never learned from."""
    remainder = F.crc32(F.col(doc_id).cast("string").cast("binary")) % 4
    return F.coalesce(remainder == 2, F.lit(False))


def sample(docs: DataFrame, labels: DataFrame, max_rows: int) -> DataFrame:
    """Texts and labels to learn from."""
    usable = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic"))
    usable = usable.where("doc_id IS NOT NULL AND toxic IN (0, 1)").where(~held_out())
    chosen = usable.groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    chosen = chosen.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_rows)
    # At most max_rows pairs of numbers, and one text for each, however often an id repeats.
    found = texts(docs).join(F.broadcast(chosen), "doc_id")
    return found.groupBy("doc_id", "toxic").agg(F.min("text").alias("text")).select("doc_id", "text", "toxic")


def learn_lexicon(train: DataFrame, max_terms: int) -> tuple[list[str], list[str]]:
    """Words and beginnings that toxic texts hold far more often than chance would have it."""

    def count(batch: pa.RecordBatch) -> pa.RecordBatch:
        tally: dict[tuple[str, bool], list[int]] = {}
        for text, toxic in zip(batch.column("text").to_pylist(), batch.column("toxic").to_pylist()):
            words = {w for w in WORDS.findall(text.lower()) if 2 < len(w) <= 40}
            terms = {(w, False) for w in words} | {(w[:k], True) for w in words for k in STEMS if k < len(w)}
            for term in terms:
                tally.setdefault(term, [0, 0])[toxic] += 1
        terms = list(tally)
        return pa.RecordBatch.from_arrays(
            [pa.array([t for t, _ in terms], pa.string()), pa.array([s for _, s in terms], pa.bool_()),
             pa.array([tally[t][1] for t in terms], pa.int64()), pa.array([tally[t][0] for t in terms], pa.int64())],
            ["term", "stem", "toxic", "other"],
        )

    schema = "term string, stem boolean, toxic long, other long"
    counted = map_batches(train.select("text", "toxic"), count, schema).groupBy("term", "stem")
    counted = counted.agg(F.sum("toxic").alias("a"), F.sum("other").alias("b"))
    sizes = {r["toxic"]: r["count"] for r in train.groupBy("toxic").count().collect()}
    n1, n0 = sizes.get(1, 0), sizes.get(0, 0)
    by_chance = (F.col("a") + F.col("b")) * F.lit(n1 / max(1, n1 + n0))
    odds = F.log((F.col("a") + 0.5) / F.lit(n1 + 1.0)) - F.log((F.col("b") + 0.5) / F.lit(n0 + 1.0))
    sure = (F.col("a") - by_chance) / F.sqrt(by_chance + 1)
    found = counted.withColumn("odds", odds).withColumn("sure", sure)
    found = found.where((F.col("odds") > 1.4) & (F.col("sure") > 4.5))
    top = found.orderBy(F.desc("sure"), "term", "stem").limit(max_terms).collect()
    return settled({r["term"]: r["a"] for r in top if not r["stem"]}, {r["term"]: r["a"] for r in top if r["stem"]})


def settled(words: dict[str, int], stems: dict[str, int], share: float = 1.5) -> tuple[list[str], list[str]]:
    """Of a word and a beginning of it the one that says more, given the toxic texts of each.

    A beginning stays if it is in ``share`` times as many texts as any one word it begins;
    then it stands for those words too.
    """
    kept = [
        s for s, n in stems.items() if n > share * max((a for w, a in words.items() if w.startswith(s)), default=0)
    ]
    return sorted(w for w in words if not w.startswith(tuple(kept))), sorted(kept)


def fit(x: np.ndarray, y: np.ndarray, pull: float = 0.5, steps: int = 40) -> np.ndarray:
    """Logistic weights by Newton steps; ``near`` is drawn towards four fifths of ``exact``, the others to zero."""
    x = np.column_stack([np.ones(len(x)), x])
    k = x.shape[1]
    penalty = pull * np.eye(k)
    penalty[0, 0] = 1e-6
    exact, near = 1 + FEATURES.index("exact"), 1 + FEATURES.index("near")
    tie = np.zeros(k)
    tie[near], tie[exact] = 1, -0.8
    penalty[near, near] = 0
    penalty += 4 * pull * np.outer(tie, tie)
    w = np.zeros(k)
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        gradient = x.T @ (p - y) + penalty @ w
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + penalty, gradient)
        w -= step * min(1.0, 4 / max(4.0, float(np.abs(step).max())))
        if np.abs(step).max() < 1e-8:
            break
    return w


def learn(docs: DataFrame, labels: DataFrame, max_rows: int = 20_000, max_terms: int = 600) -> Model:
    """A model from at most ``max_rows`` labelled rows that are not held out."""
    train = freeze(sample(docs, labels, max_rows))
    words, stems = learn_lexicon(train, max_terms)

    def measure(batch: pa.RecordBatch) -> pa.RecordBatch:
        lexicon = lexicon_of(words, stems)
        made = [features(t, lexicon) for t in batch.column("text").to_pylist()]
        return pa.RecordBatch.from_arrays(
            [batch.column("toxic"), pa.array(made, pa.list_(pa.float64()))], ["toxic", "x"]
        )

    rows = map_batches(train.select("text", "toxic"), measure, "toxic int, x array<double>").collect()
    rows.sort(key=lambda r: (r["x"], r["toxic"]))  # at most max_rows; the sums don't depend on the tasks' order
    y = np.array([r["toxic"] for r in rows], float)
    if len(set(y.tolist())) < 2:
        return Model(words, stems, [], float(y.mean()) if len(y) else 0.0)
    return Model(words, stems, fit(np.array([r["x"] for r in rows], float), y).tolist())


_lexicons: dict[tuple, Lexicon] = {}


def lexicon_of(words: list[str], stems: list[str]) -> Lexicon:
    """One automaton for all tasks of a worker; an older one makes room."""
    key = (tuple(words), tuple(stems))
    if key not in _lexicons:
        _lexicons.clear()
        _lexicons[key] = Lexicon(words, stems)
    return _lexicons[key]


def score_columns(columns: list[str]) -> tuple[str, str]:
    """Names of the added columns that none of the given ones has."""
    return free_name(columns, "toxicity"), free_name(columns, "toxic")


def scored(docs: DataFrame, model: Model, threshold: float = 0.3, slice_bytes: int = 4 << 20) -> DataFrame:
    """All columns of ``docs``, then ``toxicity`` (0 to 1) and ``toxic`` (at or above ``threshold``).

    The names are those of :func:`score_columns` where ``docs`` has such columns already.
    """
    names = docs.columns
    score, hit = score_columns(names)
    text = free_name(names, "_text")
    source = docs.withColumn(text, F.coalesce(F.col("text").cast("string"), F.lit("")))

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        lexicon, column, out = lexicon_of(model.words, model.stems), batch.column(text), []
        for a, b in byte_slices(column, slice_bytes):
            out += [model.score(features(t, lexicon)) for t in column.slice(a, b - a).to_pylist()]
        hits = [s >= threshold for s in out]
        return pa.RecordBatch.from_arrays(
            [*[batch.column(c) for c in names], pa.array(out, pa.float64()), pa.array(hits, pa.bool_())],
            [*names, score, hit],
        )

    return map_batches(source, run, f"{schema_of(docs)}, `{score}` double, `{hit}` boolean")


def toxicity(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, max_rows: int = 20_000) -> DataFrame:
    """doc_id, held_out, score and predicted of every row, by a model learned from ``labels``."""
    model = learn(docs, labels, max_rows)
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    rows = scored(own, model, threshold)
    return rows.select(
        "doc_id", held_out().alias("held_out"), F.col("toxicity").alias("score"), F.col("toxic").cast("int").alias("predicted")
    )
