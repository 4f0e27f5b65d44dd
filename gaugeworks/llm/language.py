"""Language ID with a blended-spectrum string kernel.

Two texts are compared by the n-grams of one to four letters that occur in
both: presence, not frequency, over the square root of the product of their
numbers of grams. Grams are hashed into a fixed number of buckets per length.
A bounded sample of labelled rows trains the classifier: some of its rows are
the Nystroem landmarks, their kernel matrix gives the feature map, and ridge
regression in it gives one column of weights for each language. A batch of
documents is scored by two matrix products: presence by landmarks, then
kernel values by weights.

The scores of all languages sum to one, so they tell languages apart but not
whether a text is in any of them. That is told by the greatest kernel value to
a landmark, against what training rows of as many grams reach.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from gaugeworks.llm.base import fresh, portions, table, texts

ORDERS = 4
BUCKET_BITS = 13
TRAINING_ROWS = 300
LANDMARKS = 40
RIDGE = 1e-3
UNDETERMINED = "und"
FOLDS = 5
#: Texts are learned from and scored in pieces of so many characters: the flags of longer ones fill up, and all texts look alike.
PIECE = 8_192
#: A text is in a learned language from this share of the evidence that all but a twentieth of like training rows have.
SLACK = 0.8
LIKE = 50
_SIZE = 1 << BUCKET_BITS
_CHUNK = 1 << 20
_BATCH = 64


def letter_table() -> np.ndarray:
    """Code point to lower-case letter for the first 65,536 code points; what is no letter becomes a space."""
    table = np.full(1 << 16, 32, np.uint32)
    for code in range(1 << 16):
        letter = chr(code)
        if letter.isalpha():
            lower = letter.lower()
            table[code] = ord(lower) if len(lower) == 1 else code
    return table


def letters(text: str, table: np.ndarray) -> np.ndarray:
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    found = table[np.minimum(codes, 0xFFFF)]
    for k in np.nonzero(codes > 0xFFFF)[0]:
        letter = chr(codes[k])
        found[k] = ord(letter.lower()[0]) if letter.isalpha() else 32
    return found


def presence(text: str | None, table: np.ndarray) -> np.ndarray | None:
    """One flag for each bucket of each gram length over the whole text; None without a letter.

    Every run of other characters counts as one space, and one stands at each end.
    """
    if not text:
        return None
    flags = np.zeros((ORDERS, _SIZE), bool)
    before = np.array([32], np.uint32)
    seen = False
    for start in range(0, len(text) + 1, _CHUNK):
        codes = letters(text[start : start + _CHUNK], table) if start < len(text) else np.zeros(0, np.uint32)
        if start + _CHUNK > len(text):
            codes = np.append(codes, np.uint32(32))
        seen = seen or bool((codes != 32).any())
        codes = np.concatenate((before, codes))
        space = codes == 32
        space[1:] &= space[:-1]
        space[0] = False
        codes = codes[~space]
        mixed = codes * np.uint32(0x9E3779B1)
        rolled = mixed
        for order in range(ORDERS):
            if order:
                rolled = rolled[:-1] * np.uint32(0x85EBCA6B) + mixed[order:]
            flags[order, (rolled ^ (rolled >> np.uint32(15))) * np.uint32(0x2C1B3C6D) >> np.uint32(32 - BUCKET_BITS)] = True
        before = codes[-(ORDERS - 1) :]
    return flags.reshape(-1) if seen else None


@dataclass
class Model:
    """Everything scoring needs; its size depends on the parameters and the number of languages only."""

    languages: list[str]
    buckets: np.ndarray
    landmarks: np.ndarray
    landmark_norms: np.ndarray
    weights: np.ndarray
    #: Norms and the least evidence of a text with that norm.
    bounds: tuple[np.ndarray, np.ndarray]

    def kernel(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        norms = np.sqrt(np.count_nonzero(rows, axis=1))
        kernel = rows[:, self.buckets].astype(np.float32) @ self.landmarks.T
        return kernel / (norms[:, None] * self.landmark_norms[None, :]), norms

    def scores(self, rows: np.ndarray) -> np.ndarray:
        """One row of scores for each row of presence flags."""
        return self.judged(rows)[0]

    def judged(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each row of presence flags its scores, and its evidence.

        That is the greatest kernel value over its least one; under 1 the text is in no learned language.
        """
        kernel, norms = self.kernel(rows)
        scores = np.hstack((kernel, np.ones((len(rows), 1)))) @ self.weights
        return scores, kernel.max(axis=1) / np.interp(norms, *self.bounds)


def bounds(norms: np.ndarray, greatest: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Norms and the least evidence at each, from training rows' norms and greatest kernel values to other rows.

    A part of a text shares as large a part of its grams with a landmark, so a value scales with the norm. At each
    norm the LIKE rows next above it count, scaled down, or where there are fewer the last ones as they are.
    """
    order = np.argsort(norms)
    norms, greatest = norms[order], greatest[order]
    grid = np.geomspace(1, np.sqrt(ORDERS * _SIZE), 128)
    first = np.clip(np.searchsorted(norms, grid), 0, max(0, len(norms) - LIKE))
    least = [np.quantile(greatest[k : k + LIKE] * np.minimum(1, at / norms[k : k + LIKE]), 0.05) for k, at in zip(first, grid)]
    return grid, np.maximum(SLACK * np.array(least), 1e-9)


def fit(rows: np.ndarray, labels: list[str], landmarks: int = LANDMARKS, ridge: float = RIDGE) -> Model:
    """Train on presence flags; the first `landmarks` rows of each label are the landmarks."""
    languages = sorted(set(labels))
    wanted = {name: landmarks for name in languages}
    chosen = []
    for k, name in enumerate(labels):
        if wanted[name]:
            wanted[name] -= 1
            chosen.append(k)
    buckets = np.nonzero(rows[chosen].any(axis=0))[0]
    norms = np.sqrt(np.count_nonzero(rows, axis=1))
    flags = rows[:, buckets].astype(np.float32)
    kernel = (flags @ flags[chosen].T) / (norms[:, None] * norms[chosen][None, :])
    values, vectors = np.linalg.eigh(kernel[chosen].astype(np.float64))
    good = values > 1e-8 * values.max()
    whiten = vectors[:, good] / np.sqrt(values[good])
    features = np.hstack((kernel @ whiten, np.ones((len(rows), 1))))
    targets = np.array([[float(name == other) for other in languages] for name in labels])
    penalty = ridge * len(rows) * np.eye(features.shape[1])
    penalty[-1, -1] = 0
    solved = np.linalg.solve(features.T @ features + penalty, features.T @ targets)
    weights = np.vstack((whiten @ solved[:-1], solved[-1:]))
    other = kernel.copy()
    other[chosen, np.arange(len(chosen))] = 0
    greatest = other.max(axis=1)
    rest = np.setdiff1d(np.arange(len(rows)), chosen)
    rest = rest if len(rest) >= LIKE else np.arange(len(rows))
    return Model(languages, buckets, flags[chosen], norms[chosen], weights, bounds(norms[rest], greatest[rest]))


def held_out(key: str) -> Column:
    """Whether crc32 of the key as text leaves no remainder; a null key is never held out."""
    return F.coalesce(F.crc32(F.col(key).cast("string").cast("binary")) % FOLDS == 0, F.lit(False))


def train(docs: DataFrame, rows: int = TRAINING_ROWS, key: str = "doc_id", text: str = "text", lang: str = "lang") -> Model | None:
    """Fit on at most `rows` labelled rows a language, spread by a hash of the key; None without any.

    Of a row of several pieces one with a letter is learned from, which one follows
    from the hash as well. Rows that are held out, have a null key or no letter are
    never used.
    """
    spark = docs.sparkSession
    use = docs.filter(F.col(lang).isNotNull() & F.col(key).isNotNull() & ~held_out(key))
    counts = {r[lang]: r["n"] for r in use.groupBy(lang).agg(F.count(F.lit(1)).alias("n")).collect()}
    if not counts:
        return None
    spread = F.pmod(F.xxhash64(F.col(key)), F.lit(1 << 30))
    share = [F.when(F.col(lang) == name, F.lit(int(min(1.0, rows / n) * (1 << 30)))) for name, n in counts.items()]
    order = F.xxhash64(F.col(key), F.lit(7))
    picked = use.filter(spread < F.coalesce(*share)).select(order.alias("o"), F.col(lang).alias("lang"), F.col(text).alias("text"))
    letter = spark.sparkContext.broadcast(letter_table())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for o, name, t in texts([batch], "o", "lang", "text"):
                flags = _piece_of(t, o, letter.value)
                if flags is not None:
                    found.append((o, name, np.packbits(flags).tobytes()))
            columns = list(zip(*found)) if found else [[], [], []]
            kinds = (pa.int64(), pa.string(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], ["o", "lang", "bits"])

    # Only flags of fixed size are ordered and sent to the driver, whatever the texts' lengths.
    flagged = picked.mapInArrow(run, "o long, lang string, bits binary")
    got = sorted(flagged.orderBy("o", "lang", "bits").limit(rows * len(counts)).collect())
    if not got:
        return None
    flags = np.array([np.unpackbits(np.frombuffer(r["bits"], np.uint8)).astype(bool) for r in got])
    return fit(flags, [r["lang"] for r in got])


def _piece_of(text: str | None, order: int, letter: np.ndarray) -> np.ndarray | None:
    """Flags of one piece of a text: the one that a number points to, or the next with a letter."""
    count = max(1, -(-len(text or "") // PIECE))
    tried = (presence((text or "")[k * PIECE : (k + 1) * PIECE], letter) for k in ((order + j) % count for j in range(count)))
    return next((flags for flags in tried if flags is not None), None)


def identify(docs: DataFrame, model: Model | None, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Key, held_out, lang_pred and score (0 to 1) of each row of `docs`.

    lang_pred is `und` and the score 0 where the text is null, empty or has no
    letter, and everywhere without a model (no labelled row to learn from).
    Ties go to the first language by name. Whole texts are read, in pieces of
    PIECE characters; a text's scores are the means of those of its pieces with a
    letter, by their lengths. Repeated rows come out as often as they went in;
    other columns are not read.
    """
    rows = docs.select(F.col(key).alias("key"), held_out(key).alias("held_out"), F.col(text).cast("string").alias("text"))
    kind = docs.schema[key].dataType.simpleString()
    return rows.mapInArrow(_scorer(docs.sparkSession, model), f"key {kind}, held_out boolean, lang_pred string, score double").select(
        F.col("key").alias(key), "held_out", "lang_pred", "score"
    )


def _scorer(spark: SparkSession, model: Model | None):
    """Replaces the text column of Arrow batches by the language and the score."""
    fields = model and tuple(vars(model).values())
    shared = spark.sparkContext.broadcast((fields, letter_table()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fields, letter = shared.value
        model = fields and Model(*fields)
        for batch in batches:
            found, scores = [UNDETERMINED] * batch.num_rows, [0.0] * batch.num_rows
            if model:
                weight, values, _, _ = _summed(batch, "text", model, letter)
                for k in np.flatnonzero(weight):
                    top = int(np.argmax(values[k]))
                    found[k], scores[k] = model.languages[top], float(min(1.0, max(0.0, values[k][top] / weight[k])))
            out = batch.drop_columns(["text"])
            yield pa.RecordBatch.from_arrays(
                [*out.columns, pa.array(found, pa.string()), pa.array(scores, pa.float64())],
                [*out.schema.names, "lang_pred", "score"],
            )

    return run


def _summed(batch: pa.RecordBatch, name: str, model: Model, letter: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of the pieces of each text with a letter: characters, scores by them, number, and evidence."""
    weight, count, evidence = (np.zeros(batch.num_rows) for _ in range(3))
    scores = np.zeros((batch.num_rows, len(model.languages)))
    held: list[tuple[int, int, np.ndarray]] = []

    def add() -> None:
        if held:
            owners, sizes = np.array([k for k, _, _ in held]), np.array([n for _, n, _ in held], float)
            rows = np.array([p for _, _, p in held])
            np.add.at(weight, owners, sizes)
            np.add.at(count, owners, 1)
            judged, evident = model.judged(rows)
            np.add.at(evidence, owners, evident)
            np.add.at(scores, owners, judged * sizes[:, None])
            held.clear()

    for k, (text,) in enumerate(texts([batch], name)):
        for start in range(0, len(text or ""), PIECE):
            piece = text[start : start + PIECE]
            flags = presence(piece, letter)
            if flags is not None:
                held.append((k, len(piece), flags))
            if len(held) == _BATCH:
                add()
    add()
    return weight, scores, count, evidence


def accept(docs: DataFrame, least: float = 0.0, key: str = "doc_id", text: str = "text", lang: str = "lang") -> DataFrame:
    """The rows of `docs` that are in a language the labels teach, with a score of at least `least`, all columns.

    The classifier is trained on the labelled rows of `docs` itself. Texts are
    read in pieces of PIECE characters; a text's evidence and scores are the
    means over its pieces with a letter, of the scores by their lengths. Texts without a letter go. Few grams
    tell little: of short texts only those far from all languages go.
    """
    model = train(docs, key=key, text=text, lang=lang)
    spark = docs.sparkSession
    fields = model and tuple(vars(model).values())
    shared = spark.sparkContext.broadcast((fields, letter_table()))
    # A string column is read as it is; a copy would be sent to Python beside it.
    at = text if docs.schema[text].dataType == StringType() else fresh(docs, "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fields, letter = shared.value
        model = fields and Model(*fields)
        for batch in portions(batches):
            good = np.zeros(batch.num_rows, bool)
            if model:
                weight, scores, count, evidence = _summed(batch, at, model, letter)
                score = np.clip(scores.max(axis=1) / np.maximum(weight, 1), 0, 1)
                good = (count > 0) & (evidence / np.maximum(count, 1) >= 1) & (score >= least)
            yield (batch if at == text else batch.drop_columns([at])).filter(pa.array(good))

    return (docs if at == text else docs.withColumn(at, F.col(text).cast("string"))).mapInArrow(run, docs.schema)


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return identify(docs, train(docs))


QUERIES = {"op1_language_id": op1_language_id}
