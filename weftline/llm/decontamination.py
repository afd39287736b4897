"""Benchmark decontamination: a BM25 inverted index of the test items, queried by every training passage.

Postings hold the BM25 weight of a term in an item as a share of the item's own total, so one threshold serves items of
any length. Items of like length are a class with lists and a passage size of its own, so no item's verdict hangs on how long
others are. Items lie in blocks, and for each term and block the largest weight is kept. A passage (a window of words,
half of it new) is a query of its distinct terms. Its terms in the most blocks, as long as their largest weights together
stay under a third of the threshold, can't make a hit alone: only the block lists of the others are walked, for all passages
of a text at once, and a block whose maxima, with what those terms could add, stay below the threshold is skipped. For a passage
with a block left, block-max WAND walks the lists in item order and returns every item above the threshold. Each hit is
verified in the passage that found it: word trigrams of the question and of the answer must be there.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftline.llm.common import held, map_batches, text_or_empty, written

WORDS = re.compile(r"\w+")
K1, B = 1.2, 0.75
BLOCK = 2
#: Share of the threshold that a passage's most widespread terms may add without their lists being walked.
WIDESPREAD = 1 / 3
#: Words of test items in one broadcast index; more items are taken in blocks of about this size.
INDEX_WORDS = 2_000_000
#: Words that one item may have; a longer one is refused.
ITEM_WORDS = 2_000_000
THRESHOLD = 0.6
QUESTION, ANSWER = 0.6, 0.5
NGRAM = 3
#: Words that are looked at together.
SLAB = 200_000
#: Words of the longest item of the first class.
LEAST_STEP = 32


def words_of(text: str | None) -> list[str]:
    return WORDS.findall(text.lower()) if text else []


def split_item(question: list[str], answer: list[str] | None) -> tuple[list[str], list[str]]:
    """Question and answer words; an item without an answer of its own has its last quarter for one."""
    if answer:
        return question, answer
    cut = len(question) - max(1, len(question) // 4)
    return question[:cut], question[cut:]


def ngrams(words: list[str], n: int = NGRAM) -> set[tuple[str, ...]]:
    return {tuple(words[i : i + n]) for i in range(max(1, len(words) - n + 1))} if words else set()


def length_class(words: int) -> int:
    """The words that the longest item of the same class may have: powers of two from ``LEAST_STEP`` on. A passage is two of that."""
    step = LEAST_STEP
    while step < words:
        step *= 2
    return step


class Index:
    """Items of one class of length as postings by term, in item order."""

    def __init__(self, items: list[tuple[int, list[str], list[str]]], terms: dict[str, int], step: int, frequency: dict[str, int], total: int, mean: float) -> None:
        """items: id, question words, answer words; terms: numbers of the terms of all classes; frequency: items with the term, of ``total``; mean: words an item has."""
        self.ids = [i[0] for i in items]
        self.question = [i[1] for i in items]
        self.answer = [i[2] for i in items]
        lists: list[list[tuple[int, float]]] = [[] for _ in terms]
        for doc, (_, question, answer) in enumerate(items):
            counts = Counter(question + answer)
            size = sum(counts.values())
            weights = {}
            for term, tf in counts.items():
                idf = math.log(1 + (total - frequency[term] + 0.5) / (frequency[term] + 0.5))
                weights[term] = idf * tf * (K1 + 1) / (tf + K1 * (1 - B + B * size / mean))
            whole = sum(weights.values())
            for term, w in weights.items():
                lists[terms[term]].append((doc, w / whole))
        self.step = step
        self.docs = [[d for d, _ in p] for p in lists]
        self.weights = [[w for _, w in p] for p in lists]
        self.most = np.array([max(w, default=0.0) for w in self.weights] + [0.0])
        self.has = np.array([bool(w) for w in self.weights] + [False])
        self.block_most: list[dict[int, float]] = []
        for docs, weights in zip(self.docs, self.weights, strict=True):
            most: dict[int, float] = {}
            for doc, w in zip(docs, weights, strict=True):
                most[doc // BLOCK] = max(most.get(doc // BLOCK, 0.0), w)
            self.block_most.append(most)
        # The block lists in one array, for whole documents at once.
        self.first = np.cumsum([0, *map(len, self.block_most)])
        self.blocks = np.array([b for m in self.block_most for b in m], np.int64)
        self.maxima = np.array([w for m in self.block_most for w in m.values()], np.float64)
        self.n_blocks = len(items) // BLOCK + 1

    def above(self, terms: list[int], threshold: float) -> list[tuple[int, float]]:
        """Items whose score for the distinct ``terms`` is ``threshold`` at least, by block-max WAND."""
        out = []
        most, docs, block_most = self.most, self.docs, self.block_most
        cursors = [[docs[t][0], 0, t] for t in terms]
        slack = threshold - 1e-9
        while cursors:
            cursors.sort()
            bound, pivot = 0.0, -1
            for k, (_, _, t) in enumerate(cursors):
                bound += most[t]
                if bound >= slack:
                    pivot = k
                    break
            if pivot < 0:
                break
            doc = cursors[pivot][0]
            while pivot + 1 < len(cursors) and cursors[pivot + 1][0] == doc:
                pivot += 1
            block = doc // BLOCK
            bound = sum([block_most[t].get(block, 0.0) for _, _, t in cursors[: pivot + 1]])
            end = min((block + 1) * BLOCK, cursors[pivot + 1][0] if pivot + 1 < len(cursors) else len(self.ids))
            if bound >= slack:
                if cursors[0][0] == doc:
                    score = sum(self.weights[t][at] for d, at, t in cursors[: pivot + 1] if d == doc)
                    if score >= slack:
                        out.append((doc, score))
                    target = doc + 1
                else:
                    target = doc
            else:
                target = max(end, doc + 1)
            moved = []
            for k, c in enumerate(cursors):
                if k <= pivot and c[0] < target:
                    at = bisect_left(docs[c[2]], target, c[1])
                    if at == len(docs[c[2]]):
                        continue
                    c[0], c[1] = docs[c[2]][at], at
                moved.append(c)
            cursors = moved
        return out

    def hopeful(self, texts: list[np.ndarray], threshold: float) -> list[list[int]]:
        """For each text (numbers of its words' terms) the passages (two steps from each step on) with a block whose maxima reach the threshold.

        Texts are taken together, about ``SLAB`` words at a time, and a longer one in parts. The work is in proportion to the block lists walked.
        """
        size, step = len(self.docs) + 1, self.step
        out: list[list[int]] = [[] for _ in texts]
        held: list[tuple[int, int, int, np.ndarray]] = []  # text, its first passage here, how many, and the words of these passages
        total = 0

        def walk() -> None:
            lengths = np.array([len(h[3]) for h in held])
            counts = np.array([h[2] for h in held])
            base = np.cumsum(counts) - counts
            terms = np.concatenate([h[3] for h in held])
            keep = np.flatnonzero(self.has[terms])
            own = np.repeat(np.arange(len(held)), lengths)[keep]
            at = (keep - (np.cumsum(lengths) - lengths)[own]) // step
            # Each word stands in the passage of its step and in the one before.
            here, before = at < counts[own], at > 0
            passage, term = base[own] + at, terms[keep]
            pairs = np.unique(np.concatenate([passage[here] * size + term[here], (passage[before] - 1) * size + term[before]]))
            found = self._reach(pairs // size, pairs % size, int(counts.sum()), threshold)
            for p, k in zip(found.tolist(), np.searchsorted(base, found, side="right").tolist(), strict=True):
                text, first, _, _ = held[k - 1]
                out[text].append(first + p - int(base[k - 1]))
            held.clear()

        most = max(1, SLAB // step)
        for number, terms in enumerate(texts):
            passages = max(1, -(-len(terms) // step) - 1) if len(terms) else 0
            for first in range(0, passages, most):
                n = min(most, passages - first)
                held.append((number, first, n, terms[first * step : (first + n + 1) * step]))
                total += len(held[-1][3])
                if total > SLAB:
                    walk()
                    total = 0
        if held:
            walk()
        return out

    def _reach(self, passage: np.ndarray, term: np.ndarray, count: int, threshold: float) -> np.ndarray:
        """Of ``count`` passages those that have a block whose maxima, with what the widespread terms could add, reach the threshold; passage and term: distinct pairs, in order."""
        lists = self.first[term + 1] - self.first[term]
        # The most widespread terms of a passage come first; their largest weights are summed up.
        order = np.lexsort((-lists, passage))
        passage, term, lists = passage[order], term[order], lists[order]
        total = np.cumsum(self.most[term])
        begins = np.searchsorted(passage, np.arange(count + 1))
        before = np.concatenate([[0.0], total])
        spread = total - before[begins[passage]] < WIDESPREAD * threshold
        added = np.bincount(passage[spread], weights=self.most[term[spread]], minlength=count)
        sums = before[begins[1:]] - before[begins[:-1]]
        walk = ~spread & (sums[passage] >= threshold - 1e-6)
        passage, term, lists = passage[walk], term[walk], lists[walk]
        where = np.repeat(self.first[term] - np.cumsum(lists) + lists, lists) + np.arange(lists.sum())
        cell = np.repeat(passage, lists) * self.n_blocks + self.blocks[where]
        weights = self.maxima[where]
        if count * self.n_blocks <= 4 * len(cell):
            bound = np.bincount(cell, weights=weights, minlength=1)
            cells = np.flatnonzero(bound)
            bound = bound[cells]
        else:
            cells, inverse = np.unique(cell, return_inverse=True)
            bound = np.bincount(inverse, weights=weights)
        found = cells // self.n_blocks
        return np.unique(found[bound + added[found] >= threshold - 1e-6])

    def matches(self, words: list[str], terms: np.ndarray, passages: list[int], threshold: float, question: float, answer: float) -> list[tuple[int, float, float, float]]:
        """Of the hopeful passages: item, score, question and answer overlap of each item that a passage of the text holds, as in the passage with the best overlaps."""
        step = self.step
        best: dict[int, tuple[float, float, float]] = {}
        for a in passages:
            distinct = [t for t in set(terms[a * step : (a + 2) * step].tolist()) if self.has[t]]
            hits = self.above(distinct, threshold)
            if hits:
                passage = words[a * step : (a + 2) * step]
                has = ngrams(passage)
                for doc, score in hits:
                    own = self.question[doc], self.answer[doc]
                    if len(own[0]) + len(own[1]) < NGRAM:  # too short for parts: the item as a whole, as a run of words
                        own = (own[0] + own[1],) * 2
                    q, e = (overlap(part, passage, has) for part in own)
                    if q >= question and e >= answer:
                        best[doc] = max(best.get(doc, (0.0, 0.0, 0.0)), (q, e, score))
        return [(self.ids[doc], score, q, e) for doc, (q, e, score) in sorted(best.items())]


class Indexes:
    """The classes of items, with one numbering of terms."""

    def __init__(self, items: list[tuple[int, list[str], list[str]]], frequency: dict[str, int], total: int, mean: float) -> None:
        self.terms = {t: k for k, t in enumerate(dict.fromkeys(w for _, q, a in items for w in (*q, *a)))}
        classes: dict[int, list[tuple[int, list[str], list[str]]]] = {}
        for item in items:
            classes.setdefault(length_class(len(item[1]) + len(item[2])), []).append(item)
        self.classes = [Index(own, self.terms, step, frequency, total, mean) for step, own in sorted(classes.items())]

    def matches(self, texts: list[str], threshold: float, question: float, answer: float) -> list[list[tuple[int, float, float, float]]]:
        """The matches of each text."""
        get, none = self.terms.get, len(self.terms)
        words = [words_of(t) for t in texts]
        terms = [np.array([get(w, none) for w in ws], dtype=np.int64) for ws in words]
        out: list[list[tuple[int, float, float, float]]] = [[] for _ in texts]
        for own in self.classes:
            for rows, ws, ts, passages in zip(out, words, terms, own.hopeful(terms, threshold), strict=True):
                if passages:
                    rows += own.matches(ws, ts, passages, threshold, question, answer)
        return [sorted(rows) for rows in out]


def overlap(part: list[str], passage: list[str], has: set[tuple[str, ...]]) -> float:
    """Share of the trigrams of a question or an answer that the passage has; a part under a trigram is there as a run of words or not."""
    if len(part) >= NGRAM:
        own = ngrams(part)
        return len(own & has) / len(own)
    return float(any(passage[i : i + len(part)] == part for i in range(len(passage) - len(part) + 1)))


def decontaminate(docs: DataFrame, items: DataFrame, id_column: str = "doc_id", text_column: str = "text", item_column: str = "item_id", question_column: str = "text", answer_column: str | None = None, threshold: float = THRESHOLD, question: float = QUESTION, answer: float = ANSWER) -> DataFrame:
    """Items found in whole texts: id_column, text_hash, item_id, score, question_overlap, answer_overlap; one row for a row of ``docs`` and item.

    Every passage of every document is a query. text_hash (``row_key``) tells rows of one id or of null ids apart. Items
    of more than ``INDEX_WORDS`` words together are indexed in blocks, with document frequencies over all items, and the
    documents are queried with each block. Repeated items are one. An item of fewer than ``NGRAM`` words is there where its words
    stand as a run; items without a word and null texts match nothing. Repeated rows each have their matches; a null id is
    returned as it is. Empty tables of either kind give no rows. Other columns aren't read, whatever their names.
    """
    spark = docs.sparkSession
    answer_text = F.col(answer_column).cast("string") if answer_column else F.lit(None).cast("string")
    tests = items.select(F.col(item_column).cast("long").alias("item"), text_or_empty(question_column).alias("q"), answer_text.alias("a")).distinct()
    kind = dict(docs.dtypes)[id_column]
    schema = f"`{id_column}` {kind}, text_hash bigint, item_id bigint, score double, question_overlap double, answer_overlap double"
    source = docs.select(F.col(id_column).alias("__id"), row_key(text_column).alias("__hash"), text_or_empty(text_column).alias("__text"))
    lexed = map_batches(tests, ["item", "q", "a"], lambda c: iter([[c[0], *map(list, zip(*[split_item(words_of(q), words_of(a)) for q, a in zip(c[1], c[2], strict=True)], strict=True))]] if c[0] else []), "item bigint, q array<string>, a array<string>")
    lexed = written(lexed.withColumn("words", F.size("q") + F.size("a")).where("words > 0"), "items")
    total, mean, words, longest = lexed.agg(F.count("*"), F.avg("words"), F.coalesce(F.sum("words"), F.lit(0)), F.coalesce(F.max("words"), F.lit(0))).first()
    if longest > ITEM_WORDS:
        raise ValueError(f"an item has {longest} words, more than {ITEM_WORDS}")
    blocks = max(1, math.ceil(words / INDEX_WORDS))
    number = lambda n: F.pmod(F.xxhash64("item", "q", "a"), F.lit(n))
    # The hash may deal unevenly: blocks are made until each is within twice the bound.
    while blocks > 1 and lexed.groupBy(number(blocks).alias("block")).agg(F.sum("words").alias("n")).agg(F.max("n")).first()[0] > 2 * max(INDEX_WORDS, longest):
        blocks *= 2
    lexed = lexed.withColumn("block", number(blocks))
    terms = lexed.select("block", F.explode(F.array_distinct(F.concat("q", "a"))).alias("term"))
    out = None
    for block in range(blocks):
        rows = [(r.item, r.q, r.a) for r in lexed.where(F.col("block") == block).orderBy("item", "q", "a").collect()]
        mine = terms.where(F.col("block") == block).select("term").distinct()
        frequency = {r.term: r.n for r in terms.join(mine, "term").groupBy("term").agg(F.count("*").alias("n")).collect()}
        shared = spark.sparkContext.broadcast((rows, frequency, total, mean or 1.0))
        found = map_batches(source, ["__id", "__hash", "__text"], _matcher(shared, threshold, question, answer), schema)
        out = found if out is None else out.unionAll(found)
    return out


def _matcher(shared, threshold: float, question: float, answer: float):
    def work(columns: list[list]) -> Iterator[list]:
        indexes = held(shared, lambda value: Indexes(*value))
        out: list[list] = [[] for _ in range(6)]
        if indexes.classes:
            for at in range(0, len(columns[0]), 200):
                keys, hashes, texts = (c[at : at + 200] for c in columns)
                for key, hash_, rows in zip(keys, hashes, indexes.matches(texts, threshold, question, answer), strict=True):
                    for row in rows:
                        for column, value in zip(out, (key, hash_, *row), strict=True):
                            column.append(value)
        yield out

    return work


def row_key(text_column: str = "text") -> Column:
    """What tells rows of one id apart: the hash of the text, a null one as empty. Rows with equal ids and texts are alike in every result."""
    return F.xxhash64(text_or_empty(text_column))


def verdicts(docs: DataFrame, found: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """id_column, contaminated, n_items, items (ids in order) for every row of ``docs``; null ids and rows of one id have each their own matches."""
    by = found.groupBy(F.col(id_column).alias("__id"), "text_hash").agg(F.array_sort(F.collect_set("item_id")).alias("items"))
    rows = docs.select(F.col(id_column), row_key(text_column).alias("__hash"))
    joined = rows.join(by, rows[id_column].eqNullSafe(by["__id"]) & (rows["__hash"] == by["text_hash"]), "left")
    return joined.select(id_column, F.col("items").isNotNull().alias("contaminated"), F.coalesce(F.size("items"), F.lit(0)).cast("long").alias("n_items"), F.coalesce("items", F.array().cast("array<bigint>")).alias("items"))
