"""Phrase collocations by best-first branch-and-bound growth.

Phrases grow to the right from their first two words. A phrase that begins with p and holds a more word has, at its first
cut, at most f(p) occurrences over at least f(first word) + f(p): counts of prefixes alone bound the score of all that grows
from p. Nodes are expanded from the largest bound down, a batch of them in one scan, until each language has enough surviving
phrases above the largest bound that is left. The scan counts every longer phrase that holds an expanded pair anywhere, so
it also finds all that may cover a phrase of such a score.

Rare phrases never leave a task as text: scans first send packed 64-bit hashes and learn which are frequent enough; only
those are counted by their words. What tasks get of a level is a table of fixed size, whatever the input.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .shared import partitions, store
from .shingles import chunks, mix, span_hashes

LEAST, TOP, LONGEST = 30, 2000, 4
SCALE = 2_000_000
#: A phrase goes if a longer one that holds it has COVER percent of its occurrences.
COVER = 80
UNKNOWN = "und"
#: Tasks know what is frequent or expanded by 2**CELL_BITS cells of a byte; phrases that share one are only counted in vain.
CELL_BITS = 23
FREQUENT, EXPANDED = 1, 2
#: Hashes that a task sorts and sends at a time, occurrences that one task merges, and phrases that a task counts by name.
FLUSH_HASHES, PART_HASHES, FLUSH_NAMES = 1 << 21, 1 << 22, 1 << 18
#: The first batch of nodes reaches down to the score of this many times TOP pairs; each next one is twice as deep.
AHEAD = 2

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_KIND = np.zeros(256, np.uint8)  # 1: between words, 2: between pieces
_KIND[[0x20, 0x09]] = 1
_KIND[[*b".,;:!?", *range(0x0A, 0x0E)]] = 2
_FACTORS = mix(np.arange(1, LONGEST + 1, dtype=np.uint64) * np.uint64(0xE7037ED1A0B428DB)) | np.uint64(1)


class Words:
    """The words of a run of texts: hashes, spans, piece of each, and the language of each as a hash and an index."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, langs: np.ndarray, names: np.ndarray):
        self.low = _LOWER[data]
        kind = _KIND[self.low]
        inside = np.zeros(len(data) + 2, bool)
        inside[1:-1] = kind == 0
        starts, ends = inside[1:-1] & ~inside[:-2], inside[1:-1] & ~inside[2:]
        edges = offsets[(offsets > 0) & (offsets < len(data))]
        starts[edges] = inside[1:-1][edges]
        ends[edges - 1] = inside[1:-1][edges - 1]
        self.s, self.e = np.flatnonzero(starts), np.flatnonzero(ends) + 1
        text = np.searchsorted(offsets, self.s, side="right") - 1
        self.piece = np.cumsum(kind == 2)[self.s] + text
        self.lang = langs[text]
        self.salt = names[self.lang]
        self.hash = span_hashes(data, self.s, self.e)

    def grams(self, width: int) -> tuple[np.ndarray, np.ndarray]:
        """Where runs of width words within a piece begin, and their hashes, which tell languages apart."""
        n = max(len(self.s) - width + 1, 0)
        at = np.flatnonzero(self.piece[:n] == self.piece[width - 1 :]) if n else np.zeros(0, np.int64)
        with np.errstate(over="ignore"):
            total = self.salt[at] + np.uint64(width)
            for k in range(width):
                total += self.hash[at + k] * _FACTORS[k]
            return at, mix(total)

    def phrase(self, at: int, width: int) -> str:
        return b" ".join(self.low[self.s[i] : self.e[i]].tobytes() for i in range(at, at + width)).decode()


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[Words, list[str]]]:
    """Words of the columns text and lang (the first two), some texts at a time, and the languages' names."""
    for batch in batches:
        coded = batch.column(1).cast(pa.string()).fill_null(UNKNOWN).dictionary_encode()
        names = coded.dictionary.to_pylist()
        salts = np.array([xxhash.xxh64_intdigest(x) for x in names] or [0], np.uint64)
        index = coded.indices.to_numpy(zero_copy_only=False)
        for at, end, data, offsets in chunks(batch.column(0)):
            yield Words(data, offsets, index[at:end], salts), names


def _cell(hashes: np.ndarray) -> np.ndarray:
    return (hashes >> np.uint64(64 - CELL_BITS)).astype(np.int64)


def _all_flagged(cells: np.ndarray, words: Words, at: np.ndarray, width: int) -> np.ndarray:
    """Whether all pairs of words in the runs are frequent and one of them is expanded, as far as cells tell."""
    places, pairs = words.grams(2)
    flags = np.zeros(len(words.s), np.uint8)
    flags[places] = cells[_cell(pairs)]
    every, some = flags[at], flags[at]
    for k in range(1, width - 1):
        every, some = every & flags[at + k], some | flags[at + k]
    return (every & FREQUENT > 0) & (some & EXPANDED > 0)


def frequent_cells(docs: DataFrame, widths: tuple[int, ...], least: int, words_in_all: int, cells: np.ndarray | None) -> DataFrame:
    """cell, flag: the cells of the hashes of runs that occur least times at least.

    Each task sends sorted distinct hashes with their counts, packed, to the part that their first bits name; there are as
    many parts as keeps each of bounded size. With cells, runs that they rule out aren't counted.
    """
    parts = max(partitions(docs.sparkSession), -(-words_in_all * len(widths) // PART_HASHES))
    shared = docs.sparkSession.sparkContext.broadcast(cells)

    def pack(hashes: np.ndarray) -> pa.RecordBatch:
        values, counts = np.unique(hashes, return_counts=True)
        part = ((values >> np.uint64(32)) * np.uint64(parts) >> np.uint64(32)).astype(np.int64)
        own, begin = np.unique(part, return_index=True)
        rows = []
        for b, e in zip(begin, [*begin[1:], len(values)], strict=True):
            steps = np.diff(values[b:e], prepend=np.uint64(0)).view(np.uint8).reshape(-1, 8).T
            rows.append(zstandard.compress(steps.tobytes() + np.minimum(counts[b:e], least).astype(np.uint32).tobytes(), 1))
        return pa.RecordBatch.from_arrays([pa.array(own, pa.int32()), pa.array(rows, pa.binary())], ["part", "hashes"])

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, waiting, held = shared.value, [], 0
        for words, _ in _runs(batches):
            for width in widths:
                at, hashes = words.grams(width)
                if table is not None:
                    hashes = hashes[_all_flagged(table, words, at, width)]
                waiting.append(hashes)
                held += len(hashes)
            if held > FLUSH_HASHES:
                yield pack(np.concatenate(waiting))
                waiting, held = [], 0
        if held:
            yield pack(np.concatenate(waiting))

    def merge(table: pa.Table) -> pa.Table:
        values, counts = [], []
        for packed in table.column("hashes").to_pylist():
            raw = np.frombuffer(zstandard.decompress(packed), np.uint8)
            n = len(raw) // 12
            steps = np.ascontiguousarray(raw[: 8 * n].reshape(8, n).T).view(np.uint64).ravel()
            values.append(np.cumsum(steps, dtype=np.uint64))
            counts.append(raw[8 * n :].view(np.uint32))
        values, counts = np.concatenate(values), np.concatenate(counts).astype(np.int64)
        order = np.argsort(values, kind="stable")
        values, counts = values[order], counts[order]
        begin = np.flatnonzero(np.concatenate(([True], values[1:] != values[:-1])))
        frequent = values[begin[np.add.reduceat(counts, begin) >= least]]
        return pa.table({"cell": pa.array(np.unique(_cell(frequent)), pa.int32()), "flag": pa.array(np.full(len(np.unique(_cell(frequent))), FREQUENT), pa.int32())})

    packed = docs.select("text", "lang").mapInArrow(scan, "part int, hashes binary")
    return packed.repartition(parts, "part").groupBy("part").applyInArrow(merge, "cell int, flag int")


def phrase_cells(phrases: DataFrame) -> DataFrame:
    """phrases (phrase, lang, flag) -> cell, flag."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            flags, done = batch.column(2).to_numpy(), 0
            for words, _ in _runs([batch]):
                text = np.concatenate(([0], np.flatnonzero(np.diff(words.piece)) + 1)) if len(words.s) else np.zeros(0, np.int64)
                size = np.diff([*text, len(words.s)])
                found = np.zeros(len(text), np.uint64)
                for width in np.unique(size):
                    at, hashes = words.grams(int(width))
                    found[size == width] = hashes[np.isin(at, text[size == width])]
                own = pa.array(flags[done : done + len(text)], pa.int32())
                done += len(text)
                yield pa.RecordBatch.from_arrays([pa.array(_cell(found), pa.int32()), own], ["cell", "flag"])

    return phrases.select("phrase", "lang", "flag").mapInArrow(run, "cell int, flag int")


def cell_table(cells: DataFrame) -> np.ndarray:
    """The flags of all cells as one array of 2**CELL_BITS bytes; no more rows than that come to the driver."""
    found = cells.groupBy("cell").agg(F.bit_or("flag").cast("byte").alias("flag")).toArrow()
    table = np.zeros(1 << CELL_BITS, np.uint8)
    table[found.column("cell").to_numpy()] = found.column("flag").to_numpy()
    return table


def count_phrases(docs: DataFrame, widths: tuple[int, ...], chosen: np.ndarray | None = None, cells: np.ndarray | None = None) -> DataFrame:
    """lang, phrase, a: occurrences of runs of words whose hash's cell is chosen (None: all), within pieces.

    cells rules out runs as in frequent_cells. A task counts by hash and names each once.
    """
    shared = docs.sparkSession.sparkContext.broadcast((chosen, cells))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted, table = shared.value
        have: dict[int, list] = {}

        def packed() -> pa.RecordBatch:
            rows = list(have.values())
            have.clear()
            arrays = [pa.array([r[k] for r in rows], kind) for k, kind in ((0, pa.string()), (1, pa.string()), (2, pa.int64()))]
            return pa.RecordBatch.from_arrays(arrays, ["lang", "phrase", "n"])

        for words, names in _runs(batches):
            for width in widths:
                at, hashes = words.grams(width)
                if wanted is not None:
                    use = wanted[_cell(hashes)] > 0
                    at, hashes = at[use], hashes[use]
                if table is not None:
                    use = _all_flagged(table, words, at, width)
                    at, hashes = at[use], hashes[use]
                values, first, counts = np.unique(hashes, return_index=True, return_counts=True)
                for h, i, n in zip(values.tolist(), at[first].tolist(), counts.tolist(), strict=True):
                    row = have.get(h)
                    if row is None:
                        have[h] = [names[words.lang[i]], words.phrase(i, width), n]
                    else:
                        row[2] += n
            if len(have) > FLUSH_NAMES:
                yield packed()
        yield packed()

    rows = docs.select("text", "lang").mapInArrow(scan, "lang string, phrase string, n long")
    return rows.groupBy("lang", "phrase").agg(F.sum("n").alias("a"))


def _part(begin: int | Column, size: int | Column) -> Column:
    return F.array_join(F.slice("words", begin, size), " ")


def _words() -> Column:
    return F.split("phrase", " ")


def cuts(phrases: DataFrame) -> DataFrame:
    """A row for each cut of each phrase: k, left, right; other columns stay."""
    each = phrases.withColumn("words", _words()).withColumn("k", F.explode(F.sequence(F.lit(1), F.size("words") - 1)))
    return each.withColumns({"left": _part(F.lit(1), F.col("k")), "right": _part(F.col("k") + 1, F.size("words") - F.col("k"))}).drop("words")


def _score(a: Column, rest: Column) -> Column:
    """floor(SCALE * a / rest) as a long, exact beyond 64 bits."""
    return F.call_function("div", a.cast("decimal(20,0)") * F.lit(SCALE).cast("decimal(10,0)"), rest.cast("decimal(20,0)"))


def scored_cuts(phrases: DataFrame, counts: DataFrame) -> DataFrame:
    """Cuts of phrases (lang, phrase, a) with l, r and score of those of which both sides are in counts (lang, phrase, a)."""
    l, r = (counts.select("lang", F.col("phrase").alias(side), F.col("a").alias(side[0])) for side in ("left", "right"))
    return cuts(phrases).join(l, ["lang", "left"]).join(r, ["lang", "right"]).withColumn("score", _score(F.col("a"), F.col("l") + F.col("r")))


def lowest_cut(scored: DataFrame) -> DataFrame:
    """The cut that counts: the lowest score, ties to the smallest k."""
    least = scored.groupBy("lang", "phrase", "a").agg(F.min(F.struct("score", "k", "l", "r")).alias("cut"))
    return least.select("lang", "phrase", "a", "cut.l", "cut.r", "cut.score")


def score_at(rows: DataFrame, place: int) -> DataFrame:
    """lang, floor: the score at that place from the top of each language; -1 where it has fewer rows."""
    sums = rows.groupBy("lang", "score").agg(F.count(F.lit(1)).alias("n"))
    upto = F.sum("n").over(W.partitionBy("lang").orderBy(F.desc("score")).rowsBetween(W.unboundedPreceding, W.currentRow))
    return sums.withColumn("upto", upto).groupBy("lang").agg(F.coalesce(F.max(F.when(F.col("upto") >= place, F.col("score"))), F.lit(-1).cast("long")).alias("floor"))


def uncovered(candidates: DataFrame, longer: DataFrame, cover: int = COVER) -> DataFrame:
    """candidates (lang, phrase, a, ...) that no row of longer holds with cover percent of their occurrences."""
    inner = F.expr(
        "flatten(transform(sequence(2, size(words) - 1), m -> transform(sequence(1, size(words) - m + 1), i -> array_join(slice(words, i, m), ' '))))"
    )
    held = longer.filter("size(split(phrase, ' ')) > 2").withColumn("words", _words()).select("lang", F.explode(F.array_distinct(inner)).alias("phrase"), F.col("a").alias("b"))
    most = held.groupBy("lang", "phrase").agg(F.max("b").alias("b"))
    kept = candidates.join(most, ["lang", "phrase"], "left")
    exact = lambda x, by: F.col(x).cast("decimal(20,0)") * F.lit(by).cast("decimal(10,0)")
    return kept.filter(F.col("b").isNull() | (exact("b", 100) < exact("a", cover))).drop("b")


def mine_collocations(docs: DataFrame, top: int = TOP, least: int = LEAST, cover: int = COVER, ahead: int = AHEAD) -> DataFrame:
    """docs (text, lang, ...) -> lang, rank, phrase, a, l, r, n, score: each language's top phrases of 2 to 4 words.

    Words are runs outside space and tab within pieces, A-Z lower-cased; pieces end at ``.,;:!?`` and line breaks. a counts a
    phrase's occurrences, l and r those of the sides of its lowest-scoring cut, n all words of the language. Phrases with
    fewer than ``least`` occurrences, or held by a longer one with ``cover`` percent of theirs, are out.

    Null text counts as empty, null lang as "und" (with those named so); repeated rows count each time. Empty tables, and
    languages without candidates, give no rows. Other columns aren't read. Hot languages and phrases are counted in tasks
    before anything is shuffled; a language's finalists, not its candidates, meet in one task.
    """
    docs = docs.select(F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"))
    words = store(count_phrases(docs, (1,)), "words")
    sizes = store(words.groupBy("lang").agg(F.sum("a").alias("n")), "sizes")
    in_all = sizes.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    singles = words.filter(F.col("a") >= least)
    pairs = store(count_phrases(docs, (2,), cell_table(frequent_cells(docs, (2,), least, in_all, None))).filter(F.col("a") >= least), "pairs")
    bound = F.least(F.lit(SCALE // 2).cast("long"), _score(F.col("a"), F.col("l") + F.col("a")))
    nodes = store(lowest_cut(scored_cuts(pairs, singles)).withColumn("bound", bound), "nodes")

    known, going, done, place = nodes.drop("bound"), nodes.select("lang").distinct(), None, top * ahead
    while True:
        floors = store(score_at(known.join(going, "lang", "left_semi"), place), "floors")
        if floors.isEmpty():
            break
        near = nodes.join(floors, "lang")
        marked = near.select("phrase", "lang", F.when(F.col("bound") >= F.col("floor"), FREQUENT | EXPANDED).otherwise(FREQUENT).alias("flag"))
        cells = cell_table(phrase_cells(marked))
        wide = tuple(range(3, LONGEST + 1))
        chosen = cell_table(frequent_cells(docs, wide, least, in_all, cells))
        longer = count_phrases(docs, wide, chosen, cells).filter(F.col("a") >= least)
        longer = store(longer.join(floors.select("lang"), "lang", "left_semi"), "longer")
        counts = singles.unionByName(pairs).unionByName(longer)
        # the rest of a longest phrase may hold no expanded pair: it is counted if the other cuts leave the phrase a chance
        longest = longer.filter(F.size(_words()) == LONGEST)
        hopes = scored_cuts(longest, counts).filter("k > 1").groupBy("lang", "phrase", "a").agg(F.min("score").alias("score")).join(floors, "lang").filter("score >= floor")
        rests = hopes.withColumn("words", _words()).select("lang", _part(2, LONGEST - 1).alias("phrase")).distinct().join(longer, ["lang", "phrase"], "left_anti")
        rests = store(rests, "rests")
        if not rests.isEmpty():
            found = count_phrases(docs, (LONGEST - 1,), cell_table(phrase_cells(rests.withColumn("flag", F.lit(FREQUENT)))))
            counts = counts.unionByName(found.join(rests, ["lang", "phrase"], "left_semi"))
        full = scored_cuts(longer, counts)
        full = full.groupBy("lang", "phrase", "a").agg(F.min(F.struct("score", "k", "l", "r")).alias("cut"), F.count(F.lit(1)).alias("seen"))
        full = full.filter(F.col("seen") == F.size(_words()) - 1).select("lang", "phrase", "a", "cut.l", "cut.r", "cut.score")
        known = store(nodes.drop("bound").join(floors.select("lang"), "lang", "left_semi").unionByName(full), "known")
        settled = uncovered(known.join(floors, "lang").filter("score >= floor").drop("floor"), longer, cover)
        settled = store(settled, "settled")
        enough = settled.groupBy("lang").agg(F.count(F.lit(1)).alias("kept")).join(floors, "lang", "right").filter(F.coalesce("kept", F.lit(0)) >= top)
        enough = enough.select("lang").unionByName(floors.filter("floor < 0").select("lang")).distinct()
        ready = settled.join(enough, "lang", "left_semi")
        done = ready if done is None else done.unionByName(ready)
        going = store(floors.select("lang").join(enough, "lang", "left_anti"), "going")
        place *= 2
        if going.isEmpty():
            break
    if done is None:
        done = nodes.drop("bound")
    rank = F.row_number().over(W.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase"))
    best = done.withColumn("rank", rank).filter(F.col("rank") <= top).join(sizes, "lang")
    return best.select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")


ORACLE_SQL = r"""
WITH pieces AS (
  SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM (
    SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece
    FROM documents)),
grams AS (
  SELECT lang, m, unnest(list_transform(range(1, len(w) - m + 2), lambda i: array_to_string(w[i:i + m - 1], ' '))) AS phrase
  FROM pieces, (VALUES (1), (2), (3), (4)) sizes(m) WHERE len(w) >= m),
counts AS (SELECT lang, m, phrase, count(*) AS a FROM grams GROUP BY ALL),
totals AS (SELECT lang, sum(a)::BIGINT AS n FROM counts WHERE m = 1 GROUP BY lang),
candidates AS (SELECT *, string_split(phrase, ' ') AS w FROM counts WHERE m > 1 AND a >= 30),
sides AS (
  SELECT lang, phrase, a, k, array_to_string(w[1:k], ' ') AS lft, array_to_string(w[k + 1:], ' ') AS rgt
  FROM (SELECT *, unnest(range(1, m)) AS k FROM candidates)),
cut AS (
  SELECT s.lang, s.phrase, s.a, s.k, x.a AS l, y.a AS r, (2000000::HUGEINT * s.a // (x.a::HUGEINT + y.a))::BIGINT AS score
  FROM sides s JOIN counts x ON s.lang = x.lang AND s.lft = x.phrase JOIN counts y ON s.lang = y.lang AND s.rgt = y.phrase),
lowest AS (SELECT * FROM cut QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
held AS (
  SELECT lang, array_to_string(w[i:i + size - 1], ' ') AS phrase, max(a) AS b
  FROM (SELECT *, unnest(range(1, m - size + 2)) AS i FROM (SELECT *, unnest(range(2, m)) AS size FROM candidates WHERE m > 2)) GROUP BY ALL),
kept AS (SELECT c.* FROM lowest c LEFT JOIN held USING (lang, phrase) WHERE held.b IS NULL OR 100::HUGEINT * held.b < 80::HUGEINT * c.a)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score
FROM kept JOIN totals USING (lang)
QUALIFY row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) <= 2000
"""
