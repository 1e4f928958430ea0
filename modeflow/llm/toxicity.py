"""Toxicity scores: a learned lexicon in a trie, met by Levenshtein automata, with scores of the context of each match.

Learning (on a bounded sample of labelled documents): words, and word beginnings as stems, that occur in toxic documents far
more often than in others form the lexicon. The automaton of the whole lexicon is the product of its trie and the Levenshtein
automata of its terms, determinised as words are read: a state is a set of (trie node, edits used). Then the matches of each
(term, edits) and of each kind of context are counted again by label; the first give log-odds weights, the second factors.

Scoring: each match in a text weighs by its context window. Matches inside quotation marks or next to reporting words count
less (quotation), those next to words of address count more (abuse). The weights of the distinct terms of a text add up.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_right
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bounded_sample, cut, held_out, table

#: About so many labelled documents are learned from at most.
SAMPLE, SEED = 40_000, 41
#: Lengths of stems; support and strength that a term needs; words on either side of a match; the most that a text's terms add.
STEMS, SUPPORT, STRENGTH, WINDOW, MOST = (4, 5, 6), 6, 3.0, 8, 14.0
#: Terms that chance alone may let pass, of all that are tested; the largest log-odds of a text before any evidence: whatever
#: share of the labels is toxic, a text without a match stays below 0.2.
BY_CHANCE, NO_EVIDENCE = 0.05, -1.4
#: Factors of the contexts (quoted or not; nothing, a reporting word or a word of address near) before any is learned, and
#: the number of labelled documents that weighs as much as they do.
FACTORS = {"plain": 1.0, "reported": 0.3, "addressed": 1.25, "quoted plain": 0.35, "quoted reported": 0.105, "quoted addressed": 0.4375}
FACTOR_WEIGHT = 50
#: From this length on a run of letters is data rather than a word: it is matched as it is, outside of the trie.
DATA_LENGTH = 100
_TOKEN = re.compile(r"[^\W_]+(?:[@$*!|'][^\W_]+)*")
_OPEN = {'"': '"', "“": "”", "„": "“", "«": "»", "‹": "›"}
_QUOTES = re.compile('["“”„«»‹›\n]')
# Fixed word lists: reporting words and words of address.
REPORTING = frozenset("said says say wrote writes called calls quoted quote quotes quoting cited cites word term phrase sagte sagt schrieb nannte zitiert wort begriff dit disait écrit appelé cite mot terme dijo dice escribió llamó cita palabra".split())
ADDRESS = frozenset("you your you're youre u ya du dich dir dein deine ihr euch tu te toi ton ta vous votre tú ti tus usted ustedes".split())
#: The least weight of a misspelling that clean texts do not hold.
LEAST_WEIGHT = 4 / 3
#: Words that a worker keeps as known.
CLEAN_KEPT = 200_000


def allowed(term: str) -> int:
    """Edits within which a term is matched."""
    return 0 if len(term) < 5 or len(term) >= DATA_LENGTH else 1 if len(term) < 9 else 2


class Automaton:
    """The determinised product of a lexicon's trie and its Levenshtein automata, built as far as it is read.

    terms: (text, is a stem, edits allowed). A stem matches all words that begin with it, without edits.
    """

    def __init__(self, terms: list[tuple[str, bool, int]]):
        self.children: list[dict[str, int]] = [{}]
        self.words: list[list[tuple[int, int]]] = [[]]  # (term, edits allowed) that end at a node
        self.stems: list[int | None] = [None]
        self.most: list[int] = [0]  # edits allowed to any term below a node
        self.data: dict[str, int] = {}  # terms of DATA_LENGTH and more
        for number, (text, stem, edits) in enumerate(terms):
            if len(text) >= DATA_LENGTH:
                self.data[text] = number
                continue
            node = 0
            path = [0]
            for c in text:
                if c not in self.children[node]:
                    self.children[node][c] = len(self.children)
                    self.children.append({})
                    self.words.append([])
                    self.stems.append(None)
                    self.most.append(0)
                node = self.children[node][c]
                path.append(node)
            if stem:
                self.stems[node] = number
            else:
                self.words[node].append((number, edits))
                for n in path:
                    self.most[n] = max(self.most[n], edits)
        self.numbers: dict[tuple, int] = {}
        self.states: list[dict[int, int]] = []
        self.next: list[dict[str, int]] = []
        self.stem_of: list[int | None] = []
        self.start = self.state({0: 0})

    def state(self, nodes: dict[int, int]) -> int:
        """The number of the state of these nodes and edits, closed under skipped characters of the trie."""
        todo = list(nodes.items())
        while todo:
            node, edits = todo.pop()
            if nodes.get(node, 99) < edits:
                continue
            for child in self.children[node].values():
                if edits + 1 <= self.most[child] and nodes.get(child, 99) > edits + 1:
                    nodes[child] = edits + 1
                    todo.append((child, edits + 1))
        key = tuple(sorted(nodes.items()))
        if key not in self.numbers:
            self.numbers[key] = len(self.states)
            self.states.append(dict(key))
            self.next.append({})
            self.stem_of.append(next((self.stems[n] for n, e in key if e == 0 and self.stems[n] is not None), None))
        return self.numbers[key]

    def step(self, state: int, c: str) -> int:
        nodes: dict[int, int] = {}
        for node, edits in self.states[state].items():
            if edits + 1 <= self.most[node]:
                nodes[node] = min(nodes.get(node, 99), edits + 1)
            for label, child in self.children[node].items():
                cost = edits + (label != c)
                if cost <= (self.most[child] if cost else 99):
                    nodes[child] = min(nodes.get(child, 99), cost)
        found = self.next[state][c] = self.state(nodes)
        return found

    def match(self, word: str) -> tuple[int, int] | None:
        """The best (term, edits) of a word: fewest edits, whole words before stems, then the first term."""
        if word in self.data:
            return self.data[word], 0
        state, stem = self.start, None
        for c in word:
            after = self.next[state].get(c)
            state = self.step(state, c) if after is None else after
            if not self.states[state]:
                return None if stem is None else (stem, 0)
            if self.stem_of[state] is not None:
                stem = self.stem_of[state]
        ends = [(edits, term) for node, edits in self.states[state].items() for term, most in self.words[node] if edits <= most]
        if ends and (stem is None or min(ends)[0] == 0):
            edits, term = min(ends)
            return term, edits
        return None if stem is None else (stem, 0)


@lru_cache(maxsize=2)
def automaton(terms: tuple[tuple[str, bool, int], ...]) -> tuple[Automaton, dict[str, tuple[int, int]], set[str]]:
    """The automaton, and the words found to match or not so far in this worker."""
    return Automaton(list(terms)), {}, set()


def matching(terms: tuple[tuple[str, bool, int], ...], words: list[str]) -> dict[str, tuple[int, int]]:
    """The distinct words that match, with (term, edits)."""
    machine, known, clean = automaton(terms)
    new = set(words) - clean
    out = {}
    for w in new:
        hit = known.get(w)
        if hit is None:
            hit = machine.match(w)
            if hit is None:
                if len(clean) >= CLEAN_KEPT:
                    clean.clear()
                clean.add(w)
                continue
            if len(known) < CLEAN_KEPT:
                known[w] = hit
        out[w] = hit
    return out


def quoted_ranges(text: str) -> list[tuple[int, int]]:
    """Spans between quotation marks, in order and disjoint; a quotation ends on the line on which it begins."""
    out, start, closing = [], -1, ""
    for m in _QUOTES.finditer(text):
        if m[0] == "\n":
            closing = ""
        elif closing:
            if m[0] == closing:
                out.append((start, m.start()))
                closing = ""
        elif m[0] in _OPEN:
            start, closing = m.start(), _OPEN[m[0]]
    return out


def contexts(text: str, hits: dict[str, tuple[int, int]]) -> dict[tuple[int, int], set[str]]:
    """For each (term, edits) matched in a lower-cased text the kinds of its contexts (see FACTORS)."""
    tokens = [(m.start(), m.group()) for m in _TOKEN.finditer(text)]
    quotes = quoted_ranges(text)
    begins = [a for a, _ in quotes]
    marks = [0, 0]  # places up to which a reporting word and a word of address are near the words before
    ahead = 0
    out: dict[tuple[int, int], set[str]] = {}
    for i, (start, word) in enumerate(tokens):
        while ahead < len(tokens) and ahead <= i + WINDOW:
            for k, known in enumerate((REPORTING, ADDRESS)):
                if tokens[ahead][1] in known:
                    marks[k] = ahead + WINDOW + 1
            ahead += 1
        if word in hits:
            k = bisect_right(begins, start) - 1
            kind = "reported" if marks[0] > i else "addressed" if marks[1] > i else "plain"
            out.setdefault(hits[word], set()).add(f"quoted {kind}" if k >= 0 and start < quotes[k][1] else kind)
    return out


def label_counts(sample: DataFrame, found) -> DataFrame:
    """(key, pos, neg): documents by label for every key that `found` gives for a lower-cased text."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = Counter(), Counter()
        for batch in batches:
            for toxic, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                counts[toxic].update(found((text or "").lower()))
        keys = list({*counts[0], *counts[1]})
        for i in range(0, len(keys), 50_000):
            part = keys[i : i + 50_000]
            yield pa.RecordBatch.from_arrays([pa.array(part, pa.string()), pa.array([counts[1][k] for k in part], pa.int64()), pa.array([counts[0][k] for k in part], pa.int64())], ["key", "pos", "neg"])

    return sample.mapInArrow(count, "key string, pos bigint, neg bigint").groupBy("key").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))


def candidates(text: str) -> set[str]:
    """=word for the words of a text, ^stem for their beginnings."""
    words = set(_TOKEN.findall(text))
    return {f"={w}" for w in words} | {f"^{w[:n]}" for w in words for n in STEMS if len(w) > n}


def cover(sample: DataFrame, strong: DataFrame, least: int) -> list[str]:
    """The candidate terms that explain the toxic documents of the bounded sample, `least` documents each or more.

    A greedy cover in rounds: each document without a chosen term votes for the one of its candidates that most such documents
    hold (about as many: words before stems, then the surer); the candidates with enough votes are chosen. Words that only
    stand beside others, as in copies of one document, explain nothing new and stay out. strong: (key, sure).
    """

    def held(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                keys = list(candidates((text or "").lower()))
                yield pa.RecordBatch.from_arrays([pa.array([doc] * len(keys), pa.int64()), pa.array(keys, pa.string())], ["doc", "key"])

    toxic = sample.where("toxic = 1").select(F.monotonically_increasing_id().alias("doc"), "text")
    open_ = cut(toxic.mapInArrow(held, "doc bigint, key string").join(strong, "key"))
    out: list[str] = []
    while True:
        n = open_.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least)
        worth = F.struct(F.floor(25 * F.log("n")).alias("about"), F.col("key").startswith("=").alias("word"), "sure", "key")
        votes = open_.join(n, "key").groupBy("doc").agg(F.max(worth)["key"].alias("key"))
        chosen = [r["key"] for r in votes.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least).orderBy(F.desc("n"), "key").collect()]
        if not chosen:
            return out
        out += chosen
        met = open_.where(F.col("key").isin(chosen)).select("doc").distinct()
        open_ = cut(open_.join(met, "doc", "left_anti"))


def varied(sample: DataFrame, words: frozenset[str]) -> dict[str, int]:
    """For each word the number of different neighbours at its first place in the toxic documents of the sample: one for all
    copies of a document, but about the number of documents for a word of its own."""

    def places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            met: list[tuple[str, str]] = []
            for text in batch.column(0).to_pylist():
                tokens = _TOKEN.findall((text or "").lower())
                first = {w: i for i, w in zip(range(len(tokens) - 1, -1, -1), reversed(tokens), strict=True) if w in words}
                met += [(w, " ".join(tokens[max(0, i - 1) : i + 2])) for w, i in first.items()]
            yield pa.RecordBatch.from_arrays([pa.array([w for w, _ in met], pa.string()), pa.array([c for _, c in met], pa.string())], ["word", "near"])

    met = sample.where("toxic = 1").select("text").mapInArrow(places, "word string, near string")
    return {r["word"]: r["n"] for r in met.groupBy("word").agg(F.count_distinct("near").alias("n")).collect()}


class Model:
    """The lexicon, the weight of each (term, edits), the log-odds of a text without any match, and the factors of contexts."""

    def __init__(self, terms: tuple[tuple[str, bool, int], ...], weights: dict[tuple[int, int], float], prior: float, without: float, factors: dict[str, float] | None = None):
        self.terms, self.weights, self.prior, self.without = terms, weights, prior, without
        self.factors = factors or FACTORS

    def score(self, text: str) -> float:
        low = text.lower()
        hits = matching(self.terms, _TOKEN.findall(low))
        hits = {w: k for w, k in hits.items() if self.weights[k] > 0}
        if not hits:
            return 1 / (1 + math.exp(-min(NO_EVIDENCE, self.prior + self.without)))
        total = sum(self.weights[k] * max(self.factors[c] for c in kinds) for k, kinds in contexts(low, hits).items())
        return 1 / (1 + math.exp(-self.prior - min(MOST, total)))


def support(tested: int, pos: int, neg: int) -> int:
    """Toxic documents that a term needs: with fewer, chance would let more than BY_CHANCE of the tested terms pass that have
    nothing to do with the label."""
    if not pos or not neg:
        return SUPPORT
    return max(SUPPORT, math.ceil(math.log(max(1, tested) / BY_CHANCE) / math.log((pos + neg) / pos)))


def learn(labelled: DataFrame, sample: int = SAMPLE) -> Model:
    """labelled: (id, text, toxic 0 or 1), of which a bounded sample is used. Where no term is learned every text has the score
    of one without a match.

    A term needs SUPPORT toxic documents, or as many more as chance would give one of all the terms tested (that a word of so
    many documents meets toxic ones only): this floor grows with the logarithm of the number of terms, not with the sample.

    Terms may have any length; they are those of a cover of the toxic documents, and all strong words whose neighbours vary: words that often stand beside
    other terms, but not in copies only. Every learned word is matched with the edits that its length allows. A stem is matched
    exactly, but the words below it that are strong themselves are terms beside it, so that their misspellings are met, too.
    """
    chosen = bounded_sample(labelled, "id", sample, SEED).select(F.col("toxic").cast("int"), "text")
    pos, neg = chosen.agg(F.coalesce(F.sum("toxic"), F.lit(0)), F.coalesce(F.sum(1 - F.col("toxic")), F.lit(0))).first()
    prior = min(NO_EVIDENCE, math.log((pos + 0.5) / (neg + 0.5)) if pos + neg else -3.0)
    p, n = F.col("pos"), F.col("neg")
    sure = F.log((p - 1.5 * F.sqrt(p) + 0.5) / (pos + 1.0)) - F.log((n + 0.5) / (neg + 1.0))
    counted = cut(label_counts(chosen, candidates).where(p >= SUPPORT // 2))
    least = support(counted.count(), pos, neg)
    strong = cut(counted.where(p >= least).withColumn("sure", sure).where(F.col("sure") >= STRENGTH))
    rows = strong.orderBy(F.col("sure").desc(), "key").collect()
    found_terms = cover(chosen, strong.select("key", "sure"), least // 2) if rows else []
    stems = [k[1:] for k in found_terms if k[0] == "^"]
    strong_words = {r["key"][1:]: r["pos"] for r in rows if r["key"][0] == "="}
    near = varied(chosen, frozenset(strong_words)) if strong_words else {}
    own = [w for w, k in strong_words.items() if w.startswith(tuple(stems)) or near.get(w, 0) >= max(least, k / 2)]
    words = list(dict.fromkeys([*(k[1:] for k in found_terms if k[0] == "="), *own]))
    terms = tuple((w, False, allowed(w)) for w in words) + tuple((s, True, 0) for s in stems)
    if not terms:
        return Model((), {}, prior, 0.0)

    def found(text: str) -> set[str]:
        met = contexts(text, matching(terms, _TOKEN.findall(text)))
        kinds = set().union(*met.values())
        return {f"{t} {e}" for t, e in met} | ({max(kinds, key=FACTORS.get)} if kinds else {"none"})

    counts = {r["key"]: (r["pos"], r["neg"]) for r in label_counts(chosen, found).collect()}
    odds = lambda a, b, few: math.log((a + few) / (pos + 2 * few)) - math.log((b + few) / (neg + 2 * few))
    weights = {}
    for t, (text, _, edits) in enumerate(terms):
        a, b = counts.get(f"{t} 0", (0, 0))
        exact = odds(a, b, 0.5)
        weights[t, 0] = exact if exact >= STRENGTH else 0.0
        for e in range(1, edits + 1):  # unseen misspellings weigh half of the term; those that clean texts hold as well, nothing
            a, b = counts.get(f"{t} {e}", (0, 0))
            weight = 0.5 * weights[t, 0] if not a + b else min(weights[t, 0], odds(a, b, 0.5))
            weights[t, e] = weight if weight >= LEAST_WEIGHT and (not b or weight >= STRENGTH) else 0.0
    return Model(terms, weights, prior, odds(*counts.get("none", (0, 0)), 0.5), learned_factors(counts, odds))


def learned_factors(counts: dict[str, tuple[int, int]], odds) -> dict[str, float]:
    """The factor of each kind of context: the log-odds of the documents whose strongest context it is, by those of plain
    ones, and the assumed factor as so many documents more."""
    plain = odds(*counts.get("plain", (0, 0)), 0.5)
    out = {}
    for kind, assumed in FACTORS.items():
        a, b = counts.get(kind, (0, 0))
        met = odds(a, b, 0.5) / plain if plain >= STRENGTH / 2 else assumed
        out[kind] = (min(1.5, max(0.1, met)) * (a + b) + assumed * FACTOR_WEIGHT) / (a + b + FACTOR_WEIGHT)
    return out


def scored(df: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id and score (0 to 1) of every row; only the text is read.

    A null or empty text gets the score of texts without a match. Texts are scored whole. Repeated rows get equal scores.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            scores = np.array([model.score(t or "") for t in batch.column(1).to_pylist()], float)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(scores)], [id_col, "score"])

    rows = df.select(F.col(id_col), F.col(text_col).cast("string").alias("__text"))
    return rows.mapInArrow(run, f"`{id_col}` {rows.schema[id_col].dataType.simpleString()}, score double")


def labelled_rows(docs: DataFrame, labels: DataFrame, learned: Column, sample: int = SAMPLE) -> DataFrame:
    """(id, text, toxic) of the labelled documents to learn from; the labels joined are a bounded sample, and so broadcast."""
    few = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & learned).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    few = bounded_sample(few, "doc_id", sample, SEED)
    return docs.select("doc_id", "text").join(F.broadcast(few), "doc_id").select(F.col("doc_id").alias("id"), F.col("text").cast("string"), "toxic")


def filter_toxic(docs: DataFrame, labels: DataFrame, learned: Column, limit: float = 0.3) -> DataFrame:
    """The rows of docs that are not rejected: those whose score is below the limit, with all their columns."""
    model = learn(labelled_rows(docs, labels, learned))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(batch.schema.get_field_index("text")).to_pylist()
            yield batch.filter(pa.array([model.score(t or "") < limit for t in texts], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def op3_toxicity(spark, sf_dir):
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    model = learn(labelled_rows(docs, labels, ~held_out(4, 2)))
    found = scored(docs, model)
    return found.select("doc_id", F.coalesce(held_out(4, 2), F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))
