"""Hierarchical language identification: the family first, then one-versus-one linear machines within it.

Features are hashed byte n-grams (1 to 3) of the whole lower-cased text. Linear support vector machines with squared
hinge loss are fitted on a sample of the labelled rows that doesn't grow with them: for each language the rows of the
least hashes of id and text, equal rows once, as many as its equal share of FIT_ROWS but at least MIN_ROWS if it has
them. Every language is learned, so beyond FIT_ROWS / MIN_ROWS of them the sample grows with their number, and the
driver's time with its square. Languages without an entry in FAMILIES are a family of their own.

Defined cases: a text that is null or has no letter is `und` with score 0; so is every text if nothing was learned; one
learned language is predicted with score 1; a null id hashes as ''; repeated rows are judged one by one; extra columns
are kept by `predict`, which replaces columns named as its own.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from cellarium.llm.common import bound_batches, slices

FIT_ROWS, MIN_ROWS = 3000, 10
WIDTH = 4096
OWN = ("lang_pred", "score", "family")
FAMILIES = {
    "germanic": ("en", "de", "nl", "sv", "da", "no", "nb", "nn", "is", "af", "lb", "yi", "fy"),
    "romance": ("fr", "es", "it", "pt", "ro", "ca", "gl", "oc", "la"),
    "slavic": ("ru", "uk", "be", "pl", "cs", "sk", "bg", "mk", "sr", "hr", "bs", "sl"),
    "uralic": ("fi", "et", "hu"),
    "indic": ("hi", "ur", "bn", "pa", "gu", "mr", "ne"),
    "turkic": ("tr", "az", "kk", "uz"),
}
_FAMILY = {lang: family for family, langs in FAMILIES.items() for lang in langs}
_LETTER = regex.compile(r"\p{L}")


def family_of(lang: str) -> str:
    return _FAMILY.get(lang.lower().replace("_", "-").split("-")[0], f"only {lang}")


def features(text: str, width: int = WIDTH) -> np.ndarray:
    """Square roots of hashed n-gram counts, of unit length."""
    buf = np.frombuffer(f" {' '.join(text.lower().split())} ".encode(), np.uint8).astype(np.uint32)
    shift = np.uint32(32 - (width.bit_length() - 1))
    two = buf[:-1] * np.uint32(257) + buf[1:]
    three = two[:-1] * np.uint32(263) + buf[2:]
    n = sum(np.bincount((x * np.uint32(m)) >> shift, minlength=width) for x, m in ((buf, 2654435761), (two, 2246822519), (three, 3266489917)))
    x = np.sqrt(n.astype(np.float32))
    return x / np.linalg.norm(x)


def fit_machine(x: np.ndarray, y: np.ndarray, c: float = 10.0, rounds: int = 15) -> np.ndarray:
    """Weights and bias that minimise |w|^2 / 2 + c * sum of squared hinges, by Newton steps with conjugate gradients. y: -1 or 1."""
    x = np.hstack([x, np.ones((len(x), 1), x.dtype)])
    w = np.zeros(x.shape[1])
    loss = lambda w: 0.5 * w @ w + c * (np.maximum(0, 1 - y * (x @ w)) ** 2).sum()
    for _ in range(rounds):
        active = y * (x @ w) < 1
        xa = x[active]
        grad = w - 2 * c * xa.T @ (y[active] - xa @ w)
        if np.linalg.norm(grad) < 1e-3 * max(1, np.linalg.norm(w)):
            break
        step, r = np.zeros_like(w), -grad
        p, rr = r.copy(), r @ r
        for _ in range(30):
            hp = p + 2 * c * (xa.T @ (xa @ p))
            a = rr / (p @ hp)
            step += a * p
            r -= a * hp
            if (new := r @ r) < 1e-6 * (grad @ grad):
                break
            p, rr = r + new / rr * p, new
        size, now = 1.0, loss(w)
        while loss(w + size * step) > now and size > 1e-4:
            size /= 2
        w = w + size * step
    return w


@dataclass
class Model:
    families: list[str] = field(default_factory=list)
    languages: dict[str, list[str]] = field(default_factory=dict)
    weights: np.ndarray = field(default_factory=lambda: np.zeros((WIDTH + 1, 0)))
    pairs: list[tuple[str, int, int, int]] = field(default_factory=list)  # family, its languages i and j, column

    def judge(self, x: np.ndarray) -> list[tuple[str, float, str]]:
        m = x @ self.weights[:-1] + self.weights[-1]
        sure = 1 / (1 + np.exp(-3 * m))
        n = len(self.families)
        out = []
        for row in sure:
            if n == 1:
                k, p = 0, 1.0
            else:
                k = int(np.argmax(row[:n]))
                p = float(row[k] / row[:n].sum())
            family = self.families[k]
            langs = self.languages[family]
            votes = np.zeros(len(langs))
            for f, i, j, col in self.pairs:
                if f == family:
                    votes[i] += row[col]
                    votes[j] += 1 - row[col]
            best = int(np.argmax(votes))
            out.append((langs[best], p * (float(votes[best]) / (len(langs) - 1) if len(langs) > 1 else 1.0), family))
        return out


def _sampled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in slices(batch, "text"):
            rows = [(lang, features(t).astype("<f2").tobytes()) for lang, t in zip(part.column("lang").to_pylist(), part.column("text").to_pylist()) if _LETTER.search(t)]
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.binary())], ["lang", "x"])


def sample(rows: DataFrame, fit_rows: int = FIT_ROWS) -> DataFrame:
    """(lang, text) of the rows to learn from."""
    rows = rows.where("text is not null and lang is not null").where(F.col("text").rlike(r"\p{L}")).select("lang", "text", F.xxhash64(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit("language"), F.col("text")).alias("_h"))
    drawn = rows.groupBy("lang", "_h").agg(F.count(F.lit(1)))  # equal rows are one before anything is ranked
    share = max(fit_rows // max(rows.select("lang").distinct().count(), 1), MIN_ROWS)
    last = drawn.withColumn("_k", F.row_number().over(Window.partitionBy("lang").orderBy("_h"))).where(F.col("_k") <= share).groupBy("lang").agg(F.max("_h").alias("_last"))
    # one row for each language, as the model has
    return rows.join(F.broadcast(last), "lang").where("_h <= _last").groupBy("lang", "_h").agg(F.min("text").alias("text")).select("lang", "text")


def fit(rows: DataFrame, fit_rows: int = FIT_ROWS) -> Model:
    """rows: doc_id, text, lang; those with a null text or lang teach nothing."""
    bound_batches(rows.sparkSession)
    got = sample(rows, fit_rows).mapInArrow(_sampled, "lang string, x binary").orderBy("lang", "x").collect()
    if not got:
        return Model()
    x = np.array([np.frombuffer(r.x, "<f2") for r in got]).astype(np.float32)  # halves are what the driver collects
    lang = np.array([r.lang for r in got])
    del got
    known = sorted(set(lang.tolist()))
    family = np.array([family_of(v) for v in lang])
    names = sorted(set(family.tolist()))
    model = Model(names, {f: [v for v in known if family_of(v) == f] for f in names})
    cols = [fit_machine(x, np.where(family == f, 1.0, -1.0)) if len(names) > 1 else np.zeros(WIDTH + 1) for f in names]
    for f in names:
        own = model.languages[f]
        for i in range(len(own)):
            for j in range(i + 1, len(own)):
                mine = (lang == own[i]) | (lang == own[j])
                model.pairs.append((f, i, j, len(cols)))
                cols.append(fit_machine(x[mine], np.where(lang[mine] == own[i], 1.0, -1.0)))
    model.weights = np.array(cols).T.astype(np.float32)
    return model


def _predictor(bc, kept: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model: Model = bc.value
        for batch in batches:
            for part in slices(batch, "text"):
                texts = part.column("text").to_pylist()
                out: list[tuple[str, float, str | None]] = [("und", 0.0, None)] * len(texts)
                spoken = [i for i, t in enumerate(texts) if t and model.families and _LETTER.search(t)]
                for at in range(0, len(spoken), 256):
                    some = spoken[at : at + 256]
                    for i, r in zip(some, model.judge(np.array([features(texts[i]) for i in some]))):
                        out[i] = r
                cols = {c: part.column(c) for c in kept}
                yield pa.RecordBatch.from_pydict(cols | {"lang_pred": pa.array([r[0] for r in out], pa.string()), "score": pa.array([min(1.0, max(0.0, r[1])) for r in out], pa.float64()), "family": pa.array([r[2] for r in out], pa.string())})

    return run


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """docs (text, ...) with lang_pred, score and family."""
    bound_batches(docs.sparkSession)
    kept = [c for c in docs.columns if c not in OWN]
    docs = docs.select(*(F.col(f"`{c}`") for c in kept))
    bc = docs.sparkSession.sparkContext.broadcast(model)  # WIDTH floats for each family and pair of languages in it
    return docs.mapInArrow(_predictor(bc, kept), f"{docs._jdf.schema().toDDL()}, lang_pred string, score double, family string")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    fold = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))) % 4
    model = fit(docs.where(fold != 2))
    return predict(docs.select("doc_id", (fold == 2).alias("held_out"), "text"), model).select("doc_id", "held_out", "lang_pred", "score", "family")
