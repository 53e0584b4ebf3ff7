"""Language identification by nearest centroids of TF-IDF n-gram vectors."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docloom.llm.text import GOLDEN, string_buffers

SIZE = 1 << 13

# Letters in lower case; every other ASCII byte is a space; bytes above are kept.
_FOLD = np.full(256, 32, np.uint8)
_FOLD[97:123] = np.arange(97, 123)
_FOLD[65:91] = np.arange(97, 123)
_FOLD[128:] = np.arange(128, 256)


def gram_counts(raw: np.ndarray) -> np.ndarray:
    """Counts of the byte 2- and 3-grams of a text in ``SIZE`` hash classes."""
    data = np.concatenate([[32], _FOLD[raw], [32]]).astype(np.uint64)
    data = data[np.concatenate([[True], (data[1:] != 32) | (data[:-1] != 32)])]
    two = data[:-1] * np.uint64(256) + data[1:]
    three = (two[:-1] * np.uint64(256) + data[2:]) | np.uint64(1 << 24)
    shift = np.uint64(64 - 13)
    return np.bincount(
        np.concatenate([two * GOLDEN >> shift, three * GOLDEN >> shift]).astype(np.int64), minlength=SIZE
    )


def vector(counts: np.ndarray, idf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Classes and weights of a text's unit vector."""
    at = np.flatnonzero(counts)
    weight = (1 + np.log(counts[at])) * idf[at]
    return at, weight / max(float(np.sqrt(weight @ weight)), 1e-12)


def _each(batch, column: str = "text"):
    raw, bounds = string_buffers(batch.column(column))
    for i in range(len(batch)):
        yield raw[bounds[i] : bounds[i + 1]]


def document_frequencies(docs: DataFrame) -> tuple[np.ndarray, int]:
    """In how many documents each class occurs (``SIZE`` sums), and the number of documents."""

    def run(batches):
        import pyarrow as pa

        total = np.zeros(SIZE + 1, np.int64)
        for batch in batches:
            for raw in _each(batch):
                total[:SIZE] += gram_counts(raw) > 0
                total[SIZE] += 1
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], names=["gram", "n"])

    sums = docs.select("text").mapInArrow(run, "gram long, n long").groupBy("gram").agg(F.sum("n").alias("n"))
    out = np.zeros(SIZE + 1, np.int64)
    for row in sums.collect():
        out[row["gram"]] = row["n"]
    return out[:SIZE], int(out[SIZE])


def _clusters(rows: np.ndarray, k: int, rounds: int = 12) -> tuple[np.ndarray, np.ndarray]:
    """Spherical k-means from the farthest points: unit centroids and each row's cosine to its own."""
    center = rows.mean(axis=0)
    chosen = [int(np.argmax(rows @ center))]
    while len(chosen) < min(k, len(rows)):
        chosen.append(int(np.argmin((rows @ rows[chosen].T).max(axis=1))))
    centroids = rows[chosen]
    for _ in range(rounds):
        own = np.argmax(rows @ centroids.T, axis=1)
        sums = [rows[own == c].sum(axis=0) if (own == c).any() else centroids[c] for c in range(len(centroids))]
        centroids = np.stack(sums)
        centroids /= np.maximum(np.linalg.norm(centroids, axis=1, keepdims=True), 1e-12)
    return centroids, (rows @ centroids.T).max(axis=1)


def fit(training: DataFrame, centroids: int = 4, fit_docs: int = 400):
    """(languages, centroid matrix, language of each centroid, rejection cosine of each language, idf).

    Document frequencies cover all training documents. The centroids are
    clustered from about ``fit_docs`` documents per language, chosen by the
    hash of their id.
    """
    frequency, n = document_frequencies(training)
    idf = np.log((1 + n) / (1 + frequency)) + 1
    counts = {r["lang"]: r["count"] for r in training.groupBy("lang").count().collect()}
    languages = sorted(counts, key=lambda x: x.encode())
    if not languages:
        return languages, np.zeros((0, SIZE)), np.zeros(0, np.int64), np.zeros(0), idf
    part = F.create_map(*[F.lit(x) for name in languages for x in (name, min(1.0, fit_docs / counts[name]))])
    luck = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) / float(1 << 30)
    sample = training.where(luck < F.element_at(part, F.col("lang"))).select("lang", "text")

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            pairs = [vector(gram_counts(raw), idf) for raw in _each(batch)]
            places = pa.array([p[0] for p in pairs], pa.list_(pa.int64()))
            weights = pa.array([p[1] for p in pairs], pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays(
                [batch.column("lang"), places, weights],
                names=["lang", "at", "weight"],
            )

    drawn = sample.mapInArrow(run, "lang string, at array<long>, weight array<double>").toArrow().to_pylist()
    matrix, owner, reject, kept = [], [], [], []
    for name in languages:
        mine = sorted((r["at"], r["weight"]) for r in drawn if r["lang"] == name)
        rows = np.zeros((len(mine), SIZE))
        for i, (at, weight) in enumerate(mine):
            rows[i, at] = weight
        if not len(rows):
            continue
        means, own = _clusters(rows, centroids)
        matrix.append(means)
        owner += [len(kept)] * len(means)
        reject.append(float(np.quantile(own, 0.005)) * 0.8)
        kept.append(name)
    stacked = np.concatenate(matrix) if matrix else np.zeros((0, SIZE))
    return kept, stacked.astype(np.float32), np.array(owner, np.int64), np.array(reject), idf


def identify(docs: DataFrame, centroids: int = 4, fit_docs: int = 400) -> DataFrame:
    """Predicted language: doc_id, held_out, lang_pred, score, rejected.

    The model is learnt from texts with a language whose ``crc32(doc_id)`` is
    not 2 modulo 4. A text's unit TF-IDF vector is compared with every
    centroid; the language of the nearest one is the prediction, its cosine
    the score. ``rejected`` marks texts that are farther from it than nearly
    all texts of that language.

    Null texts and texts without a letter are ``und`` with score 0, as are all
    when nothing can be learnt. Equal cosines go to the language that sorts
    first. A row without id is neither learnt from nor held out. Repeated rows
    are predicted each for itself; an empty table gives no rows; further
    columns are ignored.
    """
    rest = F.crc32(F.col("doc_id").cast("string")) % 4
    training = docs.where((rest != 2) & F.col("lang").isNotNull() & F.col("text").isNotNull())
    training = training.select("doc_id", "lang", "text")
    languages, matrix, owner, reject, idf = fit(training, centroids, fit_docs)
    model = docs.sparkSession.sparkContext.broadcast((languages, matrix, owner, reject, idf))

    def run(batches):
        import pyarrow as pa

        names, rows, own, least, weights = model.value
        for batch in batches:
            letters = batch.column("letters").to_pylist()
            out = []
            for raw, some in zip(_each(batch), letters):
                if not some or not names:
                    out.append(("und", 0.0, True))
                    continue
                at, weight = vector(gram_counts(raw), weights)
                cosine = rows[:, at] @ weight
                best = int(np.argmax(cosine))
                score = min(max(float(cosine[best]), 0.0), 1.0)
                out.append((names[own[best]], score, score < least[own[best]]))
            kinds = [pa.string(), pa.float64(), pa.bool_()]
            columns = zip(*out) if out else [[]] * 3
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("held_out"), *[pa.array(c, t) for c, t in zip(columns, kinds)]],
                names=["doc_id", "held_out", "lang_pred", "score", "rejected"],
            )

    return docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.coalesce(rest == 2, F.lit(False)).alias("held_out"),
        "text",
        F.coalesce(F.regexp_like("text", F.lit(r"\p{L}")), F.lit(False)).alias("letters"),
    ).mapInArrow(run, "doc_id long, held_out boolean, lang_pred string, score double, rejected boolean")
