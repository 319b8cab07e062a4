"""Quality scores: random Fourier features over document statistics, ridge regression, isotonic calibration.

The features approximate a Gaussian kernel over the statistics of the whole text. The normal equations are summed by
partition and then on the driver, where they are solved; they are fitted on at most about FIT_ROWS labelled rows, drawn
by a hash of the id, of which every fifth (by the same hash) calibrates instead.

Defined cases: a null text is empty and gets a score like any other; rows without a label, or with a null one, teach
nothing; an id with several labels has the greatest; without labels of both kinds the score is the share of label 1
(0.5 without any); a null id hashes as ''; repeated rows are judged one by one; extra columns are kept by `score`,
which replaces columns named as its own.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cellarium.llm.common import bound_batches, materialize, slices

FIT_ROWS, FIT_PARTS = 20_000, 16
FEATURES, RIDGE = 300, 1e-3
OWN = ("score", "predicted")

_CLASS = np.zeros((256, 8))
for _i, _chars in enumerate((b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b".,;:", b"!?", b"#$%&*<>{}[]=_~^@\\/+", b"|", bytes(range(128, 192)), b"\n")):
    _CLASS[list(_chars), _i] = 1
N_STATS = 8 + 10


def statistics(text: str) -> np.ndarray:
    raw = text.encode()
    counts = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
    n = max(1, len(raw))
    share = counts[counts > 0] / n
    words = text.split()
    k = max(1, len(words))
    kinds = Counter(words)
    lines = [x for x in text.split("\n") if x.strip()]
    top = max(kinds.values(), default=0)
    return np.concatenate([
        np.sqrt(counts @ _CLASS / n),
        [np.log1p(len(raw)), np.log1p(len(words)), len(raw) / k if words else 0.0, len(kinds) / k, np.log1p(len(kinds)) / np.log1p(k),
         top / k, -float(share @ np.log2(share)) if len(share) else 0.0, 1 - len(set(lines)) / max(1, len(lines)), np.log1p(len(words) / max(1, len(lines))), sum(map(str.isupper, kinds)) / max(1, len(kinds))],
    ])


@dataclass
class Model:
    mean: np.ndarray
    scale: np.ndarray
    waves: np.ndarray
    phase: np.ndarray
    weights: np.ndarray
    knots: np.ndarray
    levels: np.ndarray

    def lift(self, x: np.ndarray) -> np.ndarray:
        """Cosine features with a constant."""
        z = np.cos(((x - self.mean) / self.scale) @ self.waves + self.phase) * np.sqrt(2 / len(self.phase))
        return np.hstack([z, np.ones((len(x), 1))])

    def score(self, x: np.ndarray) -> np.ndarray:
        return np.clip(np.interp(self.lift(x) @ self.weights, self.knots, self.levels), 0, 1)


def isotonic(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Knots and levels of the rising step function nearest to y: neighbours that fall are pooled."""
    order = np.argsort(x, kind="stable")
    blocks: list[list[float]] = []  # sum, count, least x, greatest x
    for a, b in zip(x[order].tolist(), y[order].tolist()):
        blocks.append([b, 1, a, a])
        while len(blocks) > 1 and (blocks[-2][0] * blocks[-1][1] >= blocks[-1][0] * blocks[-2][1] or blocks[-2][3] == blocks[-1][2]):
            s, n, _, high = blocks.pop()
            blocks[-1][0] += s
            blocks[-1][1] += n
            blocks[-1][3] = high
    knots, levels = [], []
    for s, n, low, high in blocks:
        for v in (low,) if low == high else (low, high):
            knots.append(v)
            levels.append(s / n)
    return np.array(knots), np.array(levels)


def _stats(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in slices(batch, "text"):
            x = [statistics(t or "").tobytes() for t in part.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.binary()), part.column("y"), part.column("fold")], ["x", "y", "fold"])


def _matrix(batch: pa.RecordBatch) -> np.ndarray:
    return np.array([np.frombuffer(b, np.float64) for b in batch.column("x").to_pylist()]).reshape(-1, N_STATS)


def _moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = np.zeros((3, N_STATS))
    for batch in batches:
        x = _matrix(batch)
        total += np.array([np.full(N_STATS, len(x)), x.sum(0), (x * x).sum(0)])
    yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], ["sums"])


def _equations(bc):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model: Model = bc.value
        k = len(model.phase) + 1
        total = np.zeros((k, k + 1))
        for batch in batches:
            z = model.lift(_matrix(batch))
            y = np.array(batch.column("y").to_pylist(), float)
            total[:, :k] += z.T @ z
            total[:, k] += z.T @ y
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], ["sums"])

    return run


def fit(docs: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS, seed: int = 7) -> Model:
    """docs: doc_id, text. labels: doc_id, quality."""
    spark = docs.sparkSession
    bound_batches(spark)
    one = labels.where("quality is not null and doc_id is not null").groupBy("doc_id").agg(F.max("quality").cast("double").alias("y"))
    n = one.count()
    rng = np.random.default_rng(seed)
    flat = Model(np.zeros(N_STATS), np.ones(N_STATS), rng.standard_normal((N_STATS, FEATURES)) / np.sqrt(N_STATS), rng.uniform(0, 2 * np.pi, FEATURES), np.zeros(FEATURES + 1), np.zeros(1), np.array([0.5]))
    if not n:
        return flat
    # the same hash on both sides keeps the join as small as the sample
    place = F.pmod(F.xxhash64(F.col("doc_id").cast("string"), F.lit("quality")), F.lit(1 << 30))
    drawn = place < int(min(1.0, fit_rows / n) * (1 << 30))
    rows = docs.where("doc_id is not null").where(drawn).select("doc_id", "text").join(one.where(drawn), "doc_id")
    stats = materialize(rows.select("text", "y", (place % 5).alias("fold")).mapInArrow(_stats, "x binary, y double, fold long"), "quality-statistics")
    dealt = stats.where("fold <> 0").repartition(FIT_PARTS)
    moments = sum(np.frombuffer(r.sums, np.float64).reshape(3, N_STATS) for r in dealt.select("x").mapInArrow(_moments, "sums binary").collect())
    if not isinstance(moments, np.ndarray) or not moments[0, 0]:
        return flat
    flat.mean = moments[1] / moments[0]
    flat.scale = np.sqrt(np.maximum(moments[2] / moments[0] - flat.mean**2, 1e-12)) + 1e-6
    k = FEATURES + 1
    sums = sum(np.frombuffer(r.sums, np.float64).reshape(k, k + 1) for r in dealt.mapInArrow(_equations(spark.sparkContext.broadcast(flat)), "sums binary").collect())
    flat.weights = np.linalg.solve(sums[:, :k] + RIDGE * moments[0, 0] * np.eye(k) / k, sums[:, k])
    held = stats.where("fold = 0").limit(fit_rows).collect() or stats.limit(fit_rows).collect()
    x = np.array([np.frombuffer(r.x, np.float64) for r in held])
    flat.knots, flat.levels = isotonic(flat.lift(x) @ flat.weights, np.array([r.y for r in held]))
    return flat


def _scorer(bc, kept: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model: Model = bc.value
        for batch in batches:
            for part in slices(batch, "text"):
                score = model.score(np.array([statistics(t or "") for t in part.column("text").to_pylist()]))
                yield pa.RecordBatch.from_pydict({c: part.column(c) for c in kept} | {"score": pa.array(score), "predicted": pa.array((score >= 0.5).astype(np.int32))})

    return run


def score(docs: DataFrame, model: Model) -> DataFrame:
    """docs (text, ...) with score and predicted."""
    bound_batches(docs.sparkSession)
    kept = [c for c in docs.columns if c not in OWN]
    docs = docs.select(*(F.col(f"`{c}`") for c in kept))
    bc = docs.sparkSession.sparkContext.broadcast(model)  # of fixed size but for the calibration's knots, at most as many as its rows
    return docs.mapInArrow(_scorer(bc, kept), f"{docs._jdf.schema().toDDL()}, score double, predicted int")


def training_fold(doc_id: str = "doc_id"):
    """True for ids whose labels may be learned from."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit(""))) % 3 != 1


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "quality")
    model = fit(docs.where(training_fold()), labels.where(training_fold()))
    return score(docs.select("doc_id", (~training_fold()).alias("held_out"), "text"), model).select("doc_id", "held_out", "score", "predicted")
