"""Quality classifier by co-training a view of the text and a view of its metadata."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import CountVectorizerModel, Normalizer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import store
from .shingles import chunks, word_hashes

#: At most so many labelled rows are used to fit and calibrate, and about so many pseudo-labels of each class and view join them.
LABELLED_ROWS, PSEUDO_ROWS = 8_000, 2_000
#: The sample is a few MB: more tasks would cost more than they save in each of many passes.
SAMPLE_PARTITIONS = 4
WORD_BITS, META_BITS = 14, 8
ROUNDS, SURE = 2, 0.97
THRESHOLD = 0.5
MAX_ITER = 25
#: Shares of letters and of capitals, of distinct words, and characters per word; logarithms of characters and lines, characters per line.
TEXT_SHAPE, META_SHAPE = 4, 3
#: Rows whose features a task holds at a time.
ROWS_AT_A_TIME = 256
SIZES = {"text": (1 << WORD_BITS) + TEXT_SHAPE, "meta": (1 << META_BITS) + META_SHAPE}
_KINDS = np.zeros(256, np.uint8)  # 1: begins a character, 2: letter, 4: capital, 8: line feed
_KINDS[[b for b in range(256) if b & 0xC0 != 0x80]] += 1
_KINDS[[*range(65, 91), *range(97, 123), *range(0xC3, 0xF0)]] += 2
_KINDS[65:91] += 4
_KINDS[10] += 8


class Features:
    """Both views of a batch of rows, as arrays.

    Text: the share of each of 2**WORD_BITS classes of words (A-Z lower-cased), and shares of letters, capitals and distinct
    words, and characters per word. Letters beyond ASCII are characters of two or three bytes. Metadata: source and language
    by class of hash, length and line layout. Null text is empty; null source or language is a value of its own.
    """

    def __init__(self, texts: pa.Array, meta: list[tuple[str, pa.Array]]):
        n = len(texts)
        self.words, self.first = [], np.zeros(n + 1, np.int64)
        kinds = np.zeros((n, 4))
        distinct = np.zeros(n)
        done = 0
        for at, end, data, offsets in chunks(texts):
            hashes, first = word_hashes(data, offsets)
            self.words.append((hashes >> np.uint64(64 - WORD_BITS)).astype(np.int64))
            self.first[at + 1 : end + 1] = done + first[1:]
            done += len(hashes)
            own = _KINDS[data]
            upto = np.zeros(len(data) + 1, np.int64)
            for k in range(4):
                np.cumsum(own >> k & 1, out=upto[1:])
                kinds[at:end, k] = upto[offsets[1:]] - upto[offsets[:-1]]
            distinct[at:end] = [len(np.unique(hashes[first[i] : first[i + 1]])) for i in range(end - at)]
        self.words = np.concatenate(self.words) if self.words else np.zeros(0, np.int64)
        count = np.maximum(np.diff(self.first), 1)
        chars, lines = np.maximum(kinds[:, 0], 1), kinds[:, 3] + 1
        self.count = count
        self.text_shape = np.stack([kinds[:, 1] / chars, kinds[:, 2] / chars, distinct / count, chars / count], axis=1)
        self.meta_shape = np.stack([np.log1p(chars), np.log1p(lines), chars / lines], axis=1)
        self.meta = np.zeros((n, len(meta)), np.int64)
        for k, (name, column) in enumerate(meta):
            coded = column.cast(pa.string()).dictionary_encode(null_encoding="encode")
            classes = [xxhash.xxh64_intdigest(f"{name}={'\0' if v is None else v}") >> (64 - META_BITS) for v in coded.dictionary.to_pylist()]
            self.meta[:, k] = np.array(classes, np.int64)[coded.indices.to_numpy(zero_copy_only=False)] if n else 0

    def margins(self, text: np.ndarray, meta: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Margins for label 1 by both views' coefficients; the last one is the intercept."""
        upto = np.concatenate(([0.0], np.cumsum(text[self.words])))
        one = (upto[self.first[1:]] - upto[self.first[:-1]]) / self.count + self.text_shape @ text[1 << WORD_BITS : -1] + text[-1]
        two = np.zeros(len(self.meta))
        for k in range(self.meta.shape[1]):
            new = (self.meta[:, :k] != self.meta[:, k : k + 1]).all(axis=1)
            two += np.where(new, meta[self.meta[:, k]], 0.0)
        return one, two + self.meta_shape @ meta[1 << META_BITS : -1] + meta[-1]


def _reader(docs: DataFrame):
    """A function that gives pieces of Arrow batches with the columns of docs, and their Features."""
    at = {c.lower(): i for i, c in enumerate(docs.columns)}
    text, meta = at["text"], [(c, at[c]) for c in ("source", "lang") if c in at]

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, Features]]:
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS_AT_A_TIME):
                part = batch.slice(at, ROWS_AT_A_TIME)
                yield part, Features(part.column(text), [(c, part.column(i)) for c, i in meta])

    return pieces


def _needed(docs: DataFrame) -> DataFrame:
    known = {c.lower() for c in docs.columns}
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", *[c for c in ("source", "lang") if c in known])


def counters() -> list[CountVectorizerModel]:
    """What counts named classes of words, and tells those of metadata that are there."""
    sizes = {"words": 1 << WORD_BITS, "meta": 1 << META_BITS}
    return [CountVectorizerModel.from_vocabulary([str(k) for k in range(n)], name, f"{name}_counts").setBinary(name == "meta") for name, n in sizes.items()]


def featurise(docs: DataFrame, counting: list[CountVectorizerModel]) -> DataFrame:
    """docs (doc_id, text, source, lang) -> doc_id, text_features, meta_features; for samples.

    Tasks name the classes and the shape of each row; Spark's own transformers make vectors of them, so that a task has one
    Python worker.
    """
    features = _reader(docs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, own in features(batches):
            words = pa.ListArray.from_arrays(pa.array(own.first, pa.int32()), pa.array(own.words).cast(pa.string()))
            meta = pa.array([[str(x) for x in row] for row in own.meta.tolist()], pa.list_(pa.string()))
            shape = np.concatenate([own.text_shape, own.meta_shape], axis=1)
            yield pa.RecordBatch.from_arrays([batch.column(0), words, meta, *map(pa.array, shape.T.copy())], names=["doc_id", "words", "meta", *names])

    names = [f"x{k}" for k in range(TEXT_SHAPE + META_SHAPE)]
    rows = docs.mapInArrow(run, "doc_id long, words array<string>, meta array<string>, " + ", ".join(f"{x} double" for x in names))
    for column, bits, counter in (("words_counts", WORD_BITS, counting[0]), ("meta_counts", META_BITS, counting[1])):
        rows = counter.transform(rows).withColumn(column, F.col(column).alias("x", metadata={"ml_attr": {"num_attrs": 1 << bits}}))
    rows = Normalizer(p=1.0, inputCol="words_counts", outputCol="shares").transform(rows)
    rows = VectorAssembler(inputCols=["shares", *names[:TEXT_SHAPE]], outputCol="text_features").transform(rows)
    rows = VectorAssembler(inputCols=["meta_counts", *names[TEXT_SHAPE:]], outputCol="meta_features").transform(rows)
    return rows.select("doc_id", *[F.col(c).alias(c, metadata={}) for c in ("text_features", "meta_features")])


class CoTrained:
    """The fitted model: both views' coefficients, their calibration, and the weights that combine them."""

    def __init__(self, text, meta, calibrations, combination):
        self.text, self.meta, self.calibrations, self.combination = text, meta, calibrations, combination

    def probabilities(self, features: Features) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of label 1, by each calibrated view and by both."""
        logits = [_clipped(m) * slope + offset for m, (slope, offset) in zip(features.margins(self.text, self.meta), self.calibrations, strict=True)]
        a, b, c = self.combination
        return tuple(1 / (1 + np.exp(-x)) for x in (*logits, a * logits[0] + b * logits[1] + c))


def _clipped(margin: np.ndarray) -> np.ndarray:
    return np.clip(margin, -30, 30)


def _fit(rows: DataFrame, features: str, **more):
    settings = {"maxIter": MAX_ITER, "regParam": 1e-3} | more
    return LogisticRegression(featuresCol=features, labelCol="label", probabilityCol="", predictionCol="", **settings).fit(rows)


def _coefficients(model) -> np.ndarray:
    """With the intercept as the last one."""
    return np.append(model.coefficients.toArray(), model.intercept)


def _margins(docs: DataFrame, text: np.ndarray, meta: np.ndarray) -> DataFrame:
    """docs (doc_id, text, source, lang) -> doc_id, text_margin, meta_margin."""
    told = docs.sparkSession.sparkContext.broadcast((text, meta))
    features = _reader(docs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, own in features(batches):
            yield pa.RecordBatch.from_arrays([batch.column(0), *map(pa.array, own.margins(*told.value))], names=["doc_id", "text_margin", "meta_margin"])

    return docs.mapInArrow(run, "doc_id long, text_margin double, meta_margin double")


def _pseudo_labels(margins: DataFrame, labels: DataFrame, turn: int, most: int, sure: float) -> DataFrame:
    """doc_id, text_says, meta_says: labels of documents without one of which a view is sure; about ``most`` by view and class.

    All documents are scored and counted. Where a view is sure of more than ``most`` of a class, a hash of the id decides.
    """
    least = float(np.log(sure / (1 - sure)))
    unlabelled = margins.filter("doc_id is not null").join(labels.select("doc_id").distinct(), "doc_id", "left_anti")
    says = {name: F.when(F.col(f"{name}_margin") > least, 1.0).when(F.col(f"{name}_margin") < -least, 0.0) for name in ("text", "meta")}
    said = store(unlabelled.select("doc_id", *[x.alias(f"{name}_says") for name, x in says.items()]).filter("text_says is not null or meta_says is not null"), "sure")
    counts = said.agg(*[F.count_if(F.col(f"{name}_says") == label).alias(f"{name}{label}") for name in says for label in (0, 1)]).first()
    place = F.pmod(F.xxhash64("doc_id", F.lit(turn)), F.lit(1 << 30))
    kept = [
        F.coalesce(*[F.when((F.col(f"{name}_says") == label) & (place < int((1 << 30) * min(1.0, most / max(counts[f"{name}{label}"], 1)))), float(label)) for label in (0, 1)]).alias(f"{name}_says")
        for name in says
    ]
    return said.select("doc_id", *kept).filter("text_says is not null or meta_says is not null").dropDuplicates(["doc_id"])


def co_train(docs: DataFrame, labels: DataFrame, labelled_rows: int = LABELLED_ROWS, pseudo_rows: int = PSEUDO_ROWS, rounds: int = ROUNDS, sure: float = SURE) -> CoTrained | None:
    """Fit on docs and labels (doc_id, quality); None where the labels don't hold both classes.

    The labelled sample is the labelled_rows ids with the least hash (a fixed bound, so it is broadcast to the scan); a
    fifth of it calibrates. In each round both views are fitted and score every document. Documents that have no label and of
    which one view is sure (probability above ``sure``) get one for the other view; of those, about pseudo_rows by view and
    class are fitted on, evenly from the whole corpus. The margins are then calibrated by Platt's method, and a logistic
    regression on both calibrated views combines them. Only coefficients and counts reach the driver.
    """
    docs = _needed(docs)
    labels = labels.filter("doc_id is not null and quality is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max("quality").cast("double").alias("label"))
    given = store(labels.orderBy(F.xxhash64("doc_id", F.lit("labelled")), "doc_id").limit(labelled_rows), "labelled")
    counting = counters()
    sample = lambda ids: featurise(docs.join(F.broadcast(ids.select("doc_id")), "doc_id", "left_semi"), counting).join(F.broadcast(ids), "doc_id")
    held_out = F.pmod(F.xxhash64("doc_id", F.lit("fold")), F.lit(5)) == 0
    rows = store(sample(given).withColumn("held_out", held_out), "features").coalesce(SAMPLE_PARTITIONS)
    columns = ["label", "text_features", "meta_features"]
    train, held = (rows.filter(x).select(*columns).persist() for x in ("not held_out", "held_out"))
    kept = [train, held]
    try:
        if train.select("label").distinct().count() < 2:
            return None
        sets = {"text": train, "meta": train}
        for turn in range(rounds + 1):
            models = {name: _fit(sets[name], f"{name}_features") for name in sets}
            if turn == rounds:
                break
            margins = store(_margins(docs, *map(_coefficients, models.values())), "margins")
            picked = store(_pseudo_labels(margins, labels, turn, pseudo_rows, sure), "picked")
            more = store(sample(picked), "pseudo").coalesce(SAMPLE_PARTITIONS)
            for name, other in (("text", "meta"), ("meta", "text")):
                says = more.filter(f"{other}_says is not null").select(F.col(f"{other}_says").alias("label"), "text_features", "meta_features")
                sets[name] = train.unionByName(says).persist()
                kept.append(sets[name])
        judged = held if held.select("label").distinct().count() == 2 else train
        for name, model in models.items():
            judged = model.setRawPredictionCol(f"{name}_raw").transform(judged)
        clipped = [F.least(F.greatest(vector_to_array(f"{name}_raw")[1], F.lit(-30.0)), F.lit(30.0)).alias(name) for name in models]
        judged = judged.select("label", *clipped).persist()
        kept.append(judged)
        calibrations = [tuple(_coefficients(_fit(VectorAssembler(inputCols=[name], outputCol="f").transform(judged), "f", standardization=False))) for name in models]
        logits = judged.select("label", *[(F.col(name) * float(a) + F.lit(float(b))).alias(name) for name, (a, b) in zip(models, calibrations, strict=True)])
        combination = _coefficients(_fit(VectorAssembler(inputCols=list(models), outputCol="f").transform(logits), "f", standardization=False))
        return CoTrained(_coefficients(models["text"]), _coefficients(models["meta"]), calibrations, tuple(combination))
    finally:
        for df in kept:
            df.unpersist()


def score_quality(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, **options) -> DataFrame:
    """docs (doc_id, text, source, lang, ...) -> doc_id, text_score, meta_score, quality_score, keep; one row per row.

    quality_score is the combined probability of label 1; a document is kept at threshold or more. Empty and null texts are
    scored like others, from what is left of them. Where labels don't hold both classes there is nothing to learn: scores
    are null and every document is kept. Repeated rows get equal scores. An empty table gives no rows.
    """
    model = co_train(docs, labels, **options)
    docs = _needed(docs)
    if model is None:
        scores = [F.lit(None).cast("double").alias(c) for c in ("text_score", "meta_score", "quality_score")]
        return docs.select("doc_id", *scores, F.lit(True).alias("keep"))
    told, features = docs.sparkSession.sparkContext.broadcast(model), _reader(docs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, own in features(batches):
            scores = told.value.probabilities(own)
            yield pa.RecordBatch.from_arrays([batch.column(0), *map(pa.array, scores), pa.array(scores[2] >= threshold)], names=["doc_id", "text_score", "meta_score", "quality_score", "keep"])

    return docs.mapInArrow(run, "doc_id long, text_score double, meta_score double, quality_score double, keep boolean")


def keep_quality(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, **options) -> DataFrame:
    """The rows of docs that the classifier keeps, with the columns of docs. Rows are scored as they stream by: no join."""
    model = co_train(docs, labels, **options)
    if model is None:
        return docs
    told, features = docs.sparkSession.sparkContext.broadcast(model), _reader(docs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, own in features(batches):
            yield batch.filter(pa.array(told.value.probabilities(own)[2] >= threshold))

    return docs.mapInArrow(run, docs.schema)
