"""Toxicity by nearest labelled examples: exact TF-IDF cosines from a block-max inverted index.

A bounded sample of labelled documents is the index. Terms are words and beginnings of words that are commoner in examples
of label 1 than chance allows; their document frequencies are counted over all documents. The index holds, by term, blocks
of examples with the largest weight in each. A query sums those maxima into one bound per block, reads blocks from the
largest bound down, and stops when no block can reach its k-th neighbour: the neighbours are exact. Their votes, weighted by
squared cosine, are turned into probabilities by isotonic regression on the examples' own votes (each without itself).
"""

from __future__ import annotations

import hashlib
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import partitions, store

#: The index holds at most so many labelled documents; its terms are at most so many.
LABELLED_ROWS, TERMS = 16_384, 2_048
#: A term must be in so many examples of label 1, more of them than expected by so many standard deviations, and by such a factor:
#: with less, common words and chance finds come in, and examples vouch for terms that they have chosen themselves.
LEAST_SUPPORT, LEAST_DEVIATIONS, LEAST_LIFT = 3, 4.0, 2.0
#: Beginnings of words that count as terms, in characters.
PREFIXES = (5, 6, 7)
NEIGHBOURS, BLOCK = 16, 64
THRESHOLD, EVIDENCE = 0.3, 3
#: Documents of a task of the search; stored vectors are narrow, and files of them would make few tasks.
TASK_ROWS = 8_192
#: Distinct terms that a task counts before it sends them off, and distinct words and vectors that it remembers.
FLUSH_TERMS, REMEMBERED = 1 << 19, 1 << 18

_WORD = re.compile("[0-9a-z\u0080-\U0010ffff]+")


def terms_of(word: str) -> list[str]:
    """A word and its beginnings; a beginning ends in ``*``, which no word holds."""
    return [word, *[word[:k] + "*" for k in PREFIXES if len(word) > k]]


def words_of(text: str | None) -> Counter:
    """Words of the whole text, lower-cased, with their counts."""
    return Counter(_WORD.findall((text or "").lower()))


def held_out(doc_id: Column) -> Column:
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("null"))) % 4 == 2


def labelled_sample(docs: DataFrame, labels: DataFrame, rows: int = LABELLED_ROWS) -> DataFrame:
    """doc_id, text, toxic of at most rows labelled documents that aren't held out, those with the least hash of their id."""
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic"))
    known = known.filter(F.col("doc_id").isNotNull() & F.col("toxic").isin(0, 1) & ~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    place = F.md5(F.col("doc_id").cast("string"))
    chosen = known.orderBy(place, "doc_id").limit(rows)
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(chosen), "doc_id")
    return own.orderBy(place, "doc_id", F.md5(F.coalesce("text", F.lit("")))).limit(rows)


def term_counts(sample: DataFrame) -> DataFrame:
    """term, ones, zeros: examples of each label that have the term."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        have = (Counter(), Counter())

        def packed() -> pa.RecordBatch:
            terms = list(have[0].keys() | have[1].keys())
            arrays = [pa.array(terms, pa.string()), *[pa.array([c[t] for t in terms], pa.int64()) for c in have]]
            for c in have:
                c.clear()
            return pa.RecordBatch.from_arrays(arrays, ["term", "zeros", "ones"])

        for batch in batches:
            for text, toxic in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                have[toxic].update({t for w in words_of(text) for t in terms_of(w)})
                if len(have[0]) + len(have[1]) > FLUSH_TERMS:
                    yield packed()
        yield packed()

    rows = sample.select("text", "toxic").mapInArrow(count, "term string, zeros long, ones long")
    return rows.groupBy("term").agg(F.sum("ones").alias("ones"), F.sum("zeros").alias("zeros"))


def choose_terms(counts: DataFrame, ones: int, zeros: int, limit: int = TERMS) -> list[str]:
    """The terms most tied to label 1, at most limit of them, in order of code points."""
    share = ones / max(ones + zeros, 1)
    expected = (F.col("ones") + F.col("zeros")) * F.lit(share)
    deviations = (F.col("ones") - expected) / F.sqrt(expected * F.lit(1 - share) + 0.5)
    tied = counts.filter((F.col("ones") >= LEAST_SUPPORT) & (deviations >= LEAST_DEVIATIONS) & (F.col("ones") >= LEAST_LIFT * expected))
    return sorted(r.term for r in tied.orderBy(deviations.desc(), "term").limit(limit).collect())


def term_vectors(docs: DataFrame, terms: list[str]) -> DataFrame:
    """docs (doc_id, text) -> doc_id, text_key, terms (ascending numbers), counts; text_key names the text."""
    number = {t: i for i, t in enumerate(terms)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, list[int]] = {}
        for batch in batches:
            ids, counts, keys = [], [], []
            for text in batch.column(1).to_pylist():
                own: Counter = Counter()
                for word, n in words_of(text).items():
                    found = known.get(word)
                    if found is None:
                        if len(known) >= REMEMBERED:
                            known.clear()
                        found = known[word] = [number[t] for t in terms_of(word) if t in number]
                    for t in found:
                        own[t] += n
                ids.append(sorted(own))
                counts.append([own[t] for t in ids[-1]])
                keys.append(hashlib.md5((text or "").encode()).hexdigest())
            arrays = [batch.column(0), pa.array(keys, pa.string()), pa.array(ids, pa.list_(pa.int32())), pa.array(counts, pa.list_(pa.int32()))]
            yield pa.RecordBatch.from_arrays(arrays, ["doc_id", "text_key", "terms", "counts"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, text_key string, terms array<int>, counts array<int>")


class BlockMaxIndex:
    """Postings by term in blocks of examples, with the largest weight of each block.

    A cell is a term in a block. Cells are in order of terms and postings in order of cells, so that a query's cells, and the
    postings of those it reads, are ranges of arrays.
    """

    def __init__(self, vectors: list[tuple[list[int], np.ndarray]], ids: list[int], toxic: list[int], block: int = BLOCK):
        """vectors: unit vectors as (ascending terms, weights). Like examples are put together, which keeps maxima tight."""
        order = sorted(range(len(ids)), key=lambda i: (vectors[i][0], ids[i]))
        self.ids = np.array([ids[i] for i in order], np.int64)
        self.toxic = np.array([toxic[i] for i in order], np.float64)
        self.block, self.blocks = block, -(-len(ids) // block)
        size = [len(vectors[i][0]) for i in order]
        term = np.array([t for i in order for t in vectors[i][0]], np.int64)
        weight = np.array([w for i in order for w in vectors[i][1]], np.float64)
        at = np.repeat(np.arange(len(order)), size)
        by = np.lexsort((at, term))
        term, self.at, self.weight = term[by], at[by], weight[by]
        cell = term * max(self.blocks, 1) + self.at // block
        own, self.cell_start = np.unique(cell, return_index=True)
        self.cell_end = np.append(self.cell_start[1:], len(cell))
        self.cell_block = own % max(self.blocks, 1)
        self.cell_max = np.maximum.reduceat(self.weight, self.cell_start) if len(cell) else np.zeros(0)
        self.term_start = np.searchsorted(own, np.arange(term.max(initial=-1) + 2) * max(self.blocks, 1))

    def _cosines(self, cells: np.ndarray, weights: np.ndarray) -> np.ndarray:
        """Cosines with all examples, of which only those in blocks whose cells are all given are whole."""
        postings = _ranges(self.cell_start[cells], self.cell_end[cells])
        share = np.repeat(weights, self.cell_end[cells] - self.cell_start[cells])
        return np.round(np.bincount(self.at[postings], share * self.weight[postings], minlength=len(self.ids)), 12)

    def nearest(self, terms: list[int], weights: np.ndarray, k: int = NEIGHBOURS, without: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Places of the k examples with the largest cosines above 0, ties to the smaller id, and those cosines.

        The blocks with the largest bounds are read first, as many as hold k examples twice. What is in them sets a limit,
        and of all other blocks those are read whose bound reaches it, also if only for a tie. Examples of the id ``without``
        are left out.
        """
        known = [i for i, t in enumerate(terms) if t + 1 < len(self.term_start)]
        t = np.array([terms[i] for i in known], np.int64)
        starts, ends = self.term_start[t], self.term_start[t + 1]
        cells, share = _ranges(starts, ends), np.repeat(weights[known], ends - starts)
        own = self.cell_block[cells]
        bounds = np.bincount(own, share * self.cell_max[cells], minlength=self.blocks)
        read = np.zeros(self.blocks, bool)
        found, limit = [], 0.0
        first = np.argsort(-bounds, kind="stable")[: max(2, -(-2 * k // self.block))]
        for step in (0, 1):
            now = np.zeros(self.blocks, bool)
            now[first] = True
            if step:
                now = ~read & (bounds >= limit - 1e-9)
            use = (now & (bounds > 0))[own]
            read |= now
            cosine = self._cosines(cells[use], share[use])
            at = np.flatnonzero(cosine > 0)
            if without is not None:
                at = at[self.ids[at] != without]
            found.append((at, cosine[at]))
            if not step and len(at) >= k:
                limit = np.partition(cosine[at], len(at) - k)[len(at) - k]
        places, cosines = (np.concatenate(x) for x in zip(*found, strict=True))
        use = cosines >= limit
        places, cosines = places[use], cosines[use]
        best = np.lexsort((self.ids[places], -cosines))[:k]
        return places[best], cosines[best]


def _ranges(starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """All numbers from each start to its end, one range after another."""
    size = ends - starts
    return np.repeat(starts - np.cumsum(size) + size, size) + np.arange(size.sum())


class Scorer:
    """The index with what makes vectors of counts and probabilities of votes."""

    def __init__(self, idf: np.ndarray):
        self.idf, self.index, self.prior, self.steps = idf, None, 0.0, (np.zeros(1), np.zeros(1))

    def vector(self, terms: list[int], counts: list[int]) -> np.ndarray:
        w = (1 + np.log(np.array(counts, np.float64))) * self.idf[terms] if len(terms) else np.zeros(0)
        size = np.sqrt((w * w).sum())
        return w / size if size > 0 else w

    def vote(self, places: np.ndarray, cosines: np.ndarray) -> float:
        """Share of label 1 among the neighbours by squared cosine; the prior counts as one neighbour at cosine 1."""
        w = cosines * cosines
        return float(((w * self.index.toxic[places]).sum() + self.prior) / (w.sum() + 1))

    def probability(self, votes: np.ndarray) -> np.ndarray:
        """Isotonic steps joined by lines; a vote's probability never falls when the vote rises."""
        return np.interp(votes, *self.steps)


def isotonic(votes: np.ndarray, labels: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Mean vote and mean label of the pools of adjacent violators; equal votes share a pool."""
    values, at = np.unique(votes, return_inverse=True)
    n, ones = np.bincount(at), np.bincount(at, labels)
    pools: list[list[float]] = []
    for v, c, o in zip(values, n, ones, strict=True):
        pools.append([v * c, o, c])
        while len(pools) > 1 and pools[-2][1] * pools[-1][2] >= pools[-1][1] * pools[-2][2]:
            last = pools.pop()
            pools[-1] = [a + b for a, b in zip(pools[-1], last, strict=True)]
    return np.array([p[0] / p[2] for p in pools]), np.array([p[1] / p[2] for p in pools])


def _searched(vectors: DataFrame, scorer: Scorer, alone: bool, tasks: int) -> DataFrame:
    """vectors -> doc_id, vote, evidence. alone: leave out the example of the same id. Equal vectors are searched once a task."""
    shared = vectors.sparkSession.sparkContext.broadcast(scorer)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        s = shared.value
        known: dict = {}
        for batch in batches:
            votes, evidence = [], []
            for i, terms, counts in zip(*[batch.column(k).to_pylist() for k in range(3)], strict=True):
                key = (tuple(terms), tuple(counts), i if alone else None)
                found = known.get(key)
                if found is None:
                    places, cosines = s.index.nearest(terms, s.vector(terms, counts), without=i if alone else None)
                    near = [{"doc_id": int(s.index.ids[p]), "cosine": float(c), "toxic": int(s.index.toxic[p])} for p, c in zip(places[:EVIDENCE], cosines, strict=False)]
                    if len(known) >= REMEMBERED:
                        known.clear()
                    found = known[key] = (s.vote(places, cosines), near)
                votes.append(found[0])
                evidence.append(found[1])
            score = s.probability(np.array(votes))
            kind = pa.list_(pa.struct([("doc_id", pa.int64()), ("cosine", pa.float64()), ("toxic", pa.int32())]))
            arrays = [batch.column(0), pa.array(votes, pa.float64()), pa.array(score, pa.float64()), pa.array(evidence, kind)]
            yield pa.RecordBatch.from_arrays(arrays, ["doc_id", "vote", "score", "evidence"])

    schema = "doc_id long, vote double, score double, evidence array<struct<doc_id: long, cosine: double, toxic: int>>"
    rows = vectors.select("doc_id", "terms", "counts").repartition(tasks)
    return rows.mapInArrow(run, schema)


def score_toxicity(docs: DataFrame, labels: DataFrame, rows: int = LABELLED_ROWS, terms: int = TERMS) -> DataFrame:
    """docs (doc_id, text, ...), labels (doc_id, toxic, ...) -> doc_id, held_out, score, predicted, evidence; a row per row of docs.

    score is the calibrated share of label 1, from 0 to 1; evidence the nearest labelled examples with cosine and label.
    Examples are documents with a label 0 or 1 that aren't held out, at most ``rows``; of a document with both labels, 1
    counts. Only texts make scores. Every document is scored, whole.

    Null and empty texts, and those without a chosen term, have no neighbours and get the probability of that. Null ids are
    scored and never examples. Repeated rows get equal scores. Without examples all scores are 0; empty docs give no rows.
    """
    sample = store(labelled_sample(docs, labels, rows), "labelled")
    size = {r.toxic: r.n for r in sample.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    chosen = choose_terms(term_counts(sample), size.get(1, 0), size.get(0, 0), terms)
    vectors = store(term_vectors(docs, chosen), "vectors")
    n_docs = vectors.count()
    found = vectors.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("n"))
    df = np.zeros(len(chosen))
    for r in found.collect():  # a row per term, at most TERMS
        df[r.term] = r.n
    scorer = Scorer(np.log((1 + n_docs) / (1 + df)) + 1)
    own = term_vectors(sample.select("doc_id", "text"), chosen).join(F.broadcast(sample.select("doc_id", "toxic").distinct()), "doc_id")
    own = store(own.select("doc_id", "terms", "counts", "toxic"), "examples")
    examples = own.orderBy("doc_id", "terms", "counts").collect()  # at most LABELLED_ROWS
    scorer.prior = size.get(1, 0) / max(sum(size.values()), 1)
    scorer.index = BlockMaxIndex([(r.terms, scorer.vector(r.terms, r.counts)) for r in examples], [r.doc_id for r in examples], [r.toxic for r in examples])
    if examples:
        votes = _searched(own, scorer, True, partitions(docs.sparkSession)).select("doc_id", "vote").join(F.broadcast(own.select("doc_id", "toxic").distinct()), "doc_id").collect()
        scorer.steps = isotonic(np.array([r.vote for r in votes]), np.array([r.toxic for r in votes], float))
    scored = _searched(vectors, scorer, False, max(partitions(docs.sparkSession), n_docs // TASK_ROWS))
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"), "evidence")
