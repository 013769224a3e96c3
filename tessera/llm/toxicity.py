"""Toxicity (5): a Levenshtein automaton intersected with a lexicon trie, and context windows that tell quotation from abuse."""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .chunks import release_caches
from .shared import only, staged, table

#: Labelled rows that the regression is fitted on, at most (those with the smallest hash of the id).
FIT_ROWS = 20_000
#: Documents that must hold a term among the toxic ones, at least; smallest log odds.
LEAST_DOCS, LEAST_ODDS = 3, 3.0
#: Terms of fewer letters match exactly only.
FUZZY_LETTERS = 5
#: Tokens on either side of a hit that are its context.
WINDOW = 8
#: Words that the automata have classified, and states that one has made, kept per worker at most; more are made anew.
SEEN_WORDS, MOST_STATES = 400_000, 200_000
#: The state from which no term is reached.
DEAD = 1

TOKEN = re.compile(r"[^\W_]+(?:[@$*!'][^\W_]+)*")
QUOTE_MARKS = "\"“”„«»‘’"
REPORTING = {"said", "says", "wrote", "writes", "called", "quote", "quoted", "quotes", "reported", "according", "claimed", "article", "word", "term", "dit", "cite", "sagte", "zitat", "dijo", "cita"}
DIRECTED = {"you", "your", "youre", "you're", "u", "ur", "are", "he", "she", "they", "such", "tu", "vous", "du", "ihr", "sie", "eres", "usted"}


class LexiconAutomaton:
    """A deterministic automaton for all words within edit distance of a lexicon's terms.

    Its states are sets of (trie node, errors) pairs: the Levenshtein automaton of the unread word intersected with the
    lexicon's trie, so that each word is read once, whatever the number of terms; they are made as words need them. Insertion, deletion, substitution
    and transposition of neighbours count one each; terms under FUZZY_LETTERS letters allow no error, others one.
    """

    def __init__(self, terms: dict[str, float]):
        self.terms = sorted(terms)
        self.weights = np.array([terms[t] for t in self.terms], float)
        children: list[dict[str, int]] = [{}]
        at_end: dict[int, int] = {}
        longest = [0]
        for k, t in enumerate(self.terms):
            node = 0
            path = [0]
            for c in t:
                if c not in children[node]:
                    children.append({})
                    longest.append(0)
                    children[node][c] = len(children) - 1
                node = children[node][c]
                path.append(node)
            at_end[node] = k
            for p in path:
                longest[p] = max(longest[p], len(t))
        self.children, self.at_end, self.longest = children, at_end, longest
        self.alphabet = sorted({c for t in self.terms for c in t})
        self.classes = np.full(0x110000, len(self.alphabet), np.uint16)
        self.classes[[ord(c) for c in self.alphabet]] = np.arange(len(self.alphabet))
        self.max_length = max([len(t) for t in self.terms], default=0) + 1
        self._restart()

    def _restart(self) -> None:
        """Only the start state (0) and the dead one (1); others are made when a word first needs them."""
        self.ids: dict[frozenset, int] = {}
        self.order: list[frozenset] = []
        self.table = np.full((64, len(self.alphabet) + 1), -1, np.int32)
        self.distance, self.term = np.full(64, 9, np.int8), np.full(64, -1, np.int32)
        self._id(self._closed({(0, 0, None)}))
        self.table[self._id(frozenset())] = DEAD

    def _id(self, state: frozenset) -> int:
        if state in self.ids:
            return self.ids[state]
        i = self.ids[state] = len(self.order)
        self.order.append(state)
        if i == len(self.table):
            self.table = np.concatenate([self.table, np.full_like(self.table, -1)])
            self.distance, self.term = np.r_[self.distance, np.full(i, 9, np.int8)], np.r_[self.term, np.full(i, -1, np.int32)]
        at_end = self.at_end
        best = min(((e, at_end[n]) for n, e, held in state if held is None and n in at_end and (e == 0 or len(self.terms[at_end[n]]) >= FUZZY_LETTERS)), default=None)
        if best:
            self.distance[i], self.term[i] = best
        return i

    def _closed(self, items: set) -> frozenset:
        """With deletions: skipping a letter of the term costs one error."""
        out = set(items)
        for node, e, held in items:
            if e == 0 and held is None and self.longest[node] >= FUZZY_LETTERS:
                out |= {(n, 1, None) for n in self.children[node].values()}
        return frozenset(out)

    def _step(self, state: frozenset, c: str | None) -> frozenset:
        out = set()
        for node, e, held in state:
            kids = self.children[node]
            if held is not None:  # the second half of a transposition: c must be the letter that was skipped
                if c == held[0]:
                    out.add((held[1], 1, None))
                continue
            if c in kids:
                out.add((kids[c], e, None))
            if e == 0 and self.longest[node] >= FUZZY_LETTERS:
                out.add((node, 1, None))
                for d, n in kids.items():
                    out.add((n, 1, None))
                    if c in self.children[n]:
                        out.add((node, 1, (d, self.children[n][c])))
        return self._closed(out)

    def _next(self, state: np.ndarray, code: np.ndarray) -> np.ndarray:
        out = self.table[state, code]
        new = np.flatnonzero(out < 0)
        if len(new):
            k = len(self.alphabet)
            for pair in np.unique(state[new].astype(np.int64) * (k + 1) + code[new]).tolist():
                i, c = divmod(pair, k + 1)
                to = self._id(self._step(self.order[i], self.alphabet[c] if c < k else None))
                self.table[i, c] = to
            out = self.table[state, code]
        return out

    def match(self, words: list[str]) -> list[tuple[str, int, int]]:
        """(word, term, distance) of the words that the automaton accepts."""
        words = [w for w in words if len(w) <= self.max_length]
        if not words or not self.terms:
            return []
        size = np.fromiter(map(len, words), np.int64, len(words))
        code = self.classes[np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.uint32)]
        begin = np.cumsum(size) - size
        state = np.zeros(len(words), np.int32)
        if len(self.order) > MOST_STATES:
            self._restart()
        for i in range(int(size.max())):
            live = np.flatnonzero((size > i) & (state != DEAD))
            state[live] = self._next(state[live], code[begin[live] + i])
        hit = np.flatnonzero(self.term[state] >= 0)
        return [(words[i], int(self.term[state[i]]), int(self.distance[state[i]])) for i in hit]


class Scorer:
    """Features of a text under one lexicon; words are classified once and remembered."""

    FEATURES = 7

    def __init__(self, automaton: LexiconAutomaton):
        self.automaton = automaton
        self.seen: set[str] = set()
        self.hits: dict[str, tuple[int, int]] = {}

    def features(self, text: str | None) -> list[float]:
        """Weighted mass of exact and misspelled hits in abuse and in quotation, hits a word, strongest term, 1.

        A hit's context is the WINDOW tokens on either side: quotation marks and reporting words speak for quotation,
        words that address or point at somebody for abuse.
        """
        text = (text or "").lower()
        words = TOKEN.findall(text)
        if len(self.seen) > SEEN_WORDS:
            self.seen, self.hits = set(), {}
        new = set(words).difference(self.seen)
        if new:
            self.hits.update({w: (t, d) for w, t, d in self.automaton.match(list(new))})
            self.seen |= new
        found = self.hits and not self.hits.keys().isdisjoint(words)
        mass, top, n = [0.0] * 4, 0.0, 0
        if found:
            hits = self.hits
            spans = [m for m in TOKEN.finditer(text)]
            counts: dict[tuple[int, int, bool], float] = {}
            for i, w in enumerate(words):
                if w not in hits:
                    continue
                term, distance = hits[w]
                lo, hi = max(0, i - WINDOW), min(len(words), i + WINDOW + 1)
                before, after = text[spans[lo].start() : spans[i].start()], text[spans[i].end() : spans[hi - 1].end()]
                near = set(words[lo:hi])
                opened = sum(before.count(q) for q in QUOTE_MARKS)
                closed = sum(after.count(q) for q in QUOTE_MARKS)
                quoting = (1.5 if opened and closed else 0.0) + len(near & REPORTING)
                abusing = 1.0 + 0.5 * len(near & DIRECTED) + 0.5 * ("!" in after[:20])
                quoted = quoting > abusing
                counts[term, distance, quoted] = counts.get((term, distance, quoted), 0) + 1
                n += 1
            for (term, distance, quoted), k in counts.items():
                w = float(self.automaton.weights[term])
                mass[2 * bool(distance) + quoted] += w * (1 + math.log(k))
                if not distance and not quoted:
                    top = max(top, w)
        return [*(math.log1p(m) for m in mass), math.sqrt(n / (len(words) + 1)), top, 1.0]


def _documents_with_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(fold, word, documents of label 0, of label 1) of each batch, from (text, toxic, fold); the empty word is in all."""
    for b in batches:
        counts: dict[tuple[int, int], Counter] = {}
        for text, toxic, fold in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist()):
            counts.setdefault((fold, toxic), Counter()).update({w for w in TOKEN.findall((text or "").lower()) if 3 <= len(w) <= 24} | {""})
        keys = sorted({(f, w) for (f, _), c in counts.items() for w in c})
        zero = Counter()
        yield pa.RecordBatch.from_arrays([pa.array([f for f, _ in keys], pa.int32()), pa.array([w for _, w in keys], pa.string()), *(pa.array([counts.get((f, t), zero)[w] for f, w in keys], pa.int64()) for t in (0, 1))], ["fold", "word", "clean", "toxic"])


def _features(lexicons: list[dict[str, float]]):
    """Features of (text, toxic, fold): each row under the lexicon of its fold."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release_caches()
        scorers = [Scorer(LexiconAutomaton(x)) for x in lexicons]
        for b in batches:
            x = [scorers[f].features(t) for t, f in zip(b.column(0).to_pylist(), b.column(2).to_pylist())]
            yield pa.RecordBatch.from_arrays([b.column(1), pa.array(x, pa.list_(pa.float64()))], ["toxic", "x"])

    return run


def _scored(automaton: LexiconAutomaton, coefficients: np.ndarray, columns: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release_caches()
        scorer = Scorer(automaton)
        for b in batches:
            x = np.array([scorer.features(t.as_py()) for t in b.column(b.num_columns - 1)], float).reshape(-1, Scorer.FEATURES)
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(_sigmoid(x @ coefficients))], columns)

    return run


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0, rounds: int = 30) -> np.ndarray:
    """Ridge-penalised logistic regression by Newton steps; the last column is the constant, free of penalty."""
    w = np.zeros(x.shape[1])
    penalty = np.r_[np.full(x.shape[1] - 1, ridge), 1e-6]
    for _ in range(rounds):
        p = _sigmoid(x @ w)
        step = np.linalg.solve((x.T * (p * (1 - p) + 1e-9)) @ x + np.diag(penalty), x.T @ (y - p) - penalty * w)
        w = w + np.clip(step, -4, 4)
        if np.abs(step).max() < 1e-7:
            break
    return w


def lexicon(counts: DataFrame, clean: int, toxic: int) -> dict[str, float]:
    """Terms with their log odds from (word, clean, toxic): all that pass."""
    odds = F.log((F.col("toxic") + 0.5) / (toxic + 1)) - F.log((F.col("clean") + 0.5) / (clean + 1))
    rows = counts.where((F.col("toxic") >= LEAST_DOCS) & (F.col("word") != "")).withColumn("odds", odds)
    return {r["word"]: r["odds"] for r in rows.where(F.col("odds") >= LEAST_ODDS).collect()}


def in_fold_zero(doc_id) -> F.Column:
    """crc32 of the id as text, modulo 5, is 0 (a null id: crc32 of the empty text, 0, so it is held out)."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 5 == 0


def toxicity(docs: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS, row: str = "doc_id") -> DataFrame:
    """One row per document: doc_id, held_out, score (0 to 1), predicted; with `row`, a column of longs, that too.

    Learns from labelled rows that aren't held out only: from all of them the words that mark toxic documents, with
    their log odds, and from fit_rows at most a logistic regression on the features of Scorer, each training row under
    a lexicon learned from the half of the labelled rows that it isn't in. Labels with a null id or value don't count;
    if an id has several, the largest does. Without both labels among the rows, no term is learned and the score is the
    share of toxic ones (0 without any). An empty or null text gets the score of a text without hits. The score depends
    on the text alone.
    """
    known = only(labels, "doc_id", "toxic").where("doc_id IS NOT NULL AND toxic IS NOT NULL").groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    known = known.where(~in_fold_zero(F.col("doc_id")))
    known = staged(known.withColumn("fold", F.pmod(F.xxhash64("doc_id", F.lit(1)), F.lit(2)).cast("int")), "toxic-labels")
    texts = only(docs, "doc_id", "text")
    counts = texts.join(known, "doc_id").select("text", "toxic", "fold").mapInArrow(_documents_with_words, "fold int, word string, clean long, toxic long")
    by_fold = [F.sum(F.when(F.col("fold") == f, F.col(c)).otherwise(0)).alias(f"{c}{f}") for c in ("clean", "toxic") for f in (0, 1)]
    counts = staged(counts.groupBy("word").agg(*by_fold).where(f"toxic0 + toxic1 >= {LEAST_DOCS} OR word = ''"), "toxic-words")
    all_docs = counts.where("word = ''").first()
    seen = {(f, t): all_docs[f"{c}{f}"] if all_docs else 0 for f in (0, 1) for t, c in enumerate(("clean", "toxic"))}
    total = {t: sum(n for (_, k), n in seen.items() if k == t) for t in (0, 1)}
    if min(total.values()) == 0:
        share = total[1] / max(1, sum(total.values()))
        terms, coefficients = {}, np.zeros(Scorer.FEATURES)
        coefficients[-1] = -30.0 if share == 0 else 30.0 if share == 1 else math.log(share / (1 - share))
    else:
        half = [lexicon(counts.selectExpr("word", f"clean{1 - f} AS clean", f"toxic{1 - f} AS toxic"), seen[1 - f, 0], seen[1 - f, 1]) for f in (0, 1)]
        terms = lexicon(counts.selectExpr("word", "clean0 + clean1 AS clean", "toxic0 + toxic1 AS toxic"), total[0], total[1])
        chosen = staged(known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(fit_rows), "toxic-chosen")
        sample = texts.join(F.broadcast(chosen), "doc_id").select("text", "toxic", "fold")  # at most fit_rows slim rows
        rows = sample.mapInArrow(_features(half), "toxic int, x array<double>").collect()
        coefficients = logistic(np.array([r["x"] for r in rows]), np.array([r["toxic"] for r in rows], float))
    carried = list(dict.fromkeys([row, "doc_id"]))
    scored = only(docs, *carried, "text").mapInArrow(_scored(LexiconAutomaton(terms), coefficients, [*carried, "score"]), ", ".join(f"{c} long" for c in carried) + ", score double")
    return scored.select(*carried, in_fold_zero(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """toxicity over the whole table of documents, learned from its labelled rows; repeated rows get a row each."""
    return toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
