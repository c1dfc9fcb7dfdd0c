"""Quality classifier by co-training on two views of a document.

One view is the text (counts of character classes, repetition, word and line shapes), the other the metadata (language,
source, stated length). A logistic model is fitted on each from the labelled documents. Over some rounds each model
scores every unlabelled document and hands the ones that it is surest of to the other model as pseudo-labels of half
weight. Then each view's scores are calibrated on labelled documents that no round has seen, and a logistic model over
both calibrated logits combines the views.

The text is read once: its features, some dozens of numbers a document, are stored in the shared folder, and rounds and
scores work on these. A round's surest documents are the best of each task's best, so no row moves but these. Fitting
takes a bounded sample of the labelled documents (LABELLED, by a hash of doc_id) and GIVEN pseudo-labels a view and
round; everything else covers all rows.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenweft.llm._common import BROADCAST_IDS, release, small_batches, stored, table

#: At most about so many labelled documents are fitted on.
LABELLED = 20_000
#: Pseudo-labels that a view gives the other in a round, in the labels' proportion, and how sure each must be.
GIVEN = 2_000
SURE = 0.98
ROUNDS = 4
KEEP_FROM = 0.5
SOURCE_BUCKETS = 64
LANG_BUCKETS = 16

_CLASS = np.zeros(256, np.int64)  # 0 control, 1 white space, 2 lower, 3 upper, 4 digit, 5 . , ; : ' " - ( ) ?, 6 !, 7 |, 8 other ASCII signs, 9 beyond ASCII
for _b in range(256):
    _c = chr(_b)
    _CLASS[_b] = 9 if _b > 127 else 1 if _c in " \t\n\r\x0b\x0c" else 2 if _c.islower() else 3 if _c.isupper() else 4 if _c.isdigit() else 5 if _c in ".,;:'\"-()?" else 6 if _c == "!" else 7 if _c == "|" else 0 if _b < 32 or _b == 127 else 8
TEXT_FEATURES = 22
SENTENCE = re.compile(r"[.!?\n]+")


def text_features(text: str | None) -> np.ndarray:
    """What the text view sees. Null and empty: zeros with a mark."""
    out = np.zeros(TEXT_FEATURES, np.float32)  # as they are stored
    words = (text or "").split()
    if not words:
        out[0] = 1
        return out
    data = np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)
    kinds = np.bincount(_CLASS, weights=np.bincount(data, minlength=256), minlength=10)
    signs = max(1.0, float(len(data) - kinds[1]))
    out[1:10] = kinds[[2, 3, 4, 5, 6, 7, 8, 9, 0]] / signs
    n = len(words)
    distinct = len(set(words))
    lengths = np.fromiter(map(len, words), np.int64, n)
    out[10] = np.log1p(n)
    out[11] = distinct / n
    out[12] = np.log1p(distinct) / np.log1p(n)
    out[13] = sum(map(str.__eq__, words, words[1:])) / n
    out[14] = lengths.mean() / 10
    out[15] = lengths.std() / 10
    out[16] = (lengths <= 3).mean()
    out[17] = min(1.0, lengths.max() / 100)
    sample = [w[-1] for w in words]
    out[18] = sum(c in "*#$%&@!~^|" for c in sample) / n
    out[19] = sum(map(str.isupper, words)) / n
    sentences = [s for s in map(str.strip, SENTENCE.split(text)) if s]
    out[20] = 1 - len(set(sentences)) / max(1, len(sentences))
    out[21] = np.log1p(n / max(1, len(sentences)))
    return out


def meta_features(lang: str | None, source: str | None, n_chars: float | None) -> np.ndarray:
    """What the metadata view sees."""
    out = np.zeros(4 + LANG_BUCKETS + SOURCE_BUCKETS)
    known = n_chars is not None and n_chars == n_chars
    out[0] = np.log1p(max(0.0, float(n_chars))) / 10 if known else 0.0
    out[1] = not known
    out[2] = lang is None
    out[3] = source is None
    if lang is not None:
        out[4 + zlib.crc32(str(lang).encode()) % LANG_BUCKETS] = 1
    if source is not None:
        out[4 + LANG_BUCKETS + zlib.crc32(str(source).encode()) % SOURCE_BUCKETS] = 1
    return out


@dataclass
class Logistic:
    """A ridge logistic model over standardised features."""

    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray

    def logit(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.mean) / self.scale, -8, 8)
        return np.clip(z @ self.weights[1:] + self.weights[0], -30, 30)

    @classmethod
    def fit(cls, x: np.ndarray, y: np.ndarray, weight: np.ndarray | None = None, ridge: float = 1.0, steps: int = 25) -> Logistic:
        weight = np.ones(len(y)) if weight is None else weight
        mean, scale = x.mean(0), x.std(0)
        scale = np.where(scale > 1e-9, scale, 1.0)
        z = np.hstack([np.ones((len(x), 1)), np.clip((x - mean) / scale, -8, 8)])
        w = np.zeros(z.shape[1])
        penalty = np.full(z.shape[1], ridge)
        penalty[0] = 1e-6
        for _ in range(steps):
            p = sigmoid(np.clip(z @ w, -30, 30))
            grad = z.T @ (weight * (p - y)) + penalty * w
            hess = (z * (weight * np.maximum(p * (1 - p), 1e-6))[:, None]).T @ z + np.diag(penalty)
            step = np.linalg.solve(hess, grad)
            size = np.abs(step).max()
            w = w - step * min(1.0, 5.0 / max(size, 1e-12))
            if size < 1e-6:
                break
        return cls(mean, scale, w)


def sigmoid(x):
    return 1 / (1 + np.exp(-x))


@dataclass
class CoTrained:
    text: Logistic
    meta: Logistic
    calibrated: tuple[Logistic, Logistic]
    combined: Logistic

    def scores(self, x: np.ndarray, m: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        a = self.calibrated[0].logit(self.text.logit(x)[:, None])
        b = self.calibrated[1].logit(self.meta.logit(m)[:, None])
        return sigmoid(a), sigmoid(b), sigmoid(self.combined.logit(np.stack([a, b], 1)))


# ---- learning ---------------------------------------------------------------------------------------------------
FEATURES = "doc_id bigint, lang string, source string, n_chars double, x array<float>"


def features(docs: DataFrame) -> DataFrame:
    """doc_id, lang, source, n_chars, x (the text view) of every row, stored; and twin, a hash of all but doc_id."""
    small_batches(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("lang").cast("string").alias("lang"), F.col("source").cast("string").alias("source"), F.col("n_chars").cast("double").alias("n_chars"), "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release(forget=True)
        for b in batches:
            found = [text_features(t) for t in b.column(4).to_pylist()]
            flat = pa.array(np.concatenate(found) if found else np.zeros(0, np.float32), pa.float32())
            x = pa.ListArray.from_arrays(pa.array(np.arange(len(found) + 1, dtype=np.int32) * TEXT_FEATURES), flat)
            yield pa.RecordBatch.from_arrays([*(b.column(i) for i in range(4)), x], ["doc_id", "lang", "source", "n_chars", "x"])
        release()

    return stored(rows.mapInArrow(run, FEATURES).withColumn("twin", F.xxhash64("lang", "source", "n_chars", "x")), "features")


def _views(f: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Both views of some rows of features()."""
    if not len(f):
        return np.zeros((0, TEXT_FEATURES)), np.zeros((0, 4 + LANG_BUCKETS + SOURCE_BUCKETS))
    meta = [meta_features(*r) for r in zip(*(f[c].astype(object).where(f[c].notna(), None) for c in ("lang", "source", "n_chars")), strict=True)]
    return np.stack(f["x"].to_list()).astype(np.float64), np.stack(meta)


def surest(pool: DataFrame, models: tuple[Logistic, Logistic], taken: set[int], amounts: tuple[int, int]) -> pd.DataFrame:
    """view, c, twin, sure, lang, source, n_chars, x: for each view and class the `amounts` rows of the pool that its
    model is surest of, at least SURE; ties go to the smaller twin. Twins, whose views are equal, count as one; those
    taken go. Every row of the pool is scored; a task gives back no more than is asked for.
    """
    shared = pool.sparkSession.sparkContext.broadcast(taken)

    def best(f: pd.DataFrame) -> pd.DataFrame:
        f = f.sort_values(["view", "c", "sure", "twin"], ascending=[True, True, False, True], kind="stable").drop_duplicates(["view", "c", "twin"])
        nth = f.groupby(["view", "c"]).cumcount()
        return f[nth < np.where(f["c"] == 1, amounts[1], amounts[0])]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[pd.DataFrame] = []
        gone = np.fromiter(shared.value, np.int64)
        for f in batches:
            f = f[~f["twin"].isin(gone)]
            if not len(f):
                continue
            for v, (model, x) in enumerate(zip(models, _views(f), strict=True)):
                p = sigmoid(model.logit(x))
                f2 = f.assign(view=v, c=(p >= 0.5).astype(int), sure=np.maximum(p, 1 - p))
                held.append(f2[f2["sure"] >= SURE])
            if sum(map(len, held)) > 4 * sum(amounts):
                held = [best(pd.concat(held))]
        if held:
            yield best(pd.concat(held))[["view", "c", "twin", "sure", "lang", "source", "n_chars", "x"]]

    found = pool.mapInPandas(run, "view int, c int, twin bigint, sure double, lang string, source string, n_chars double, x array<float>")
    # over all tasks: an ordered limit, which takes the best of each task's best
    tops = [found.where((F.col("view") == v) & (F.col("c") == c)).dropDuplicates(["twin"]).orderBy(F.desc("sure"), "twin").limit(amounts[c]) for v in (0, 1) for c in (0, 1)]
    return reduce(DataFrame.unionByName, tops).toPandas()


def co_train(known: pd.DataFrame, pool: DataFrame, rounds: int = ROUNDS, given: int = GIVEN) -> CoTrained | None:
    """known: labelled rows of features() with y; pool: the unlabelled ones. None if the labels do not hold both classes.

    Every fourth labelled row, by class, is kept for calibration and is in no round.
    """
    known = known.sort_values(["doc_id", "twin"], kind="stable")
    y, views = known["y"].to_numpy(), _views(known)
    if len(np.unique(y)) < 2:
        return None
    held = np.zeros(len(y), bool)
    for c in (0, 1):
        held[np.flatnonzero(y == c)[3::4]] = True
    fit = ~held
    sets = [[(views[v][fit], y[fit], np.ones(fit.sum()))] for v in (0, 1)]
    taken: set[int] = set()
    amounts = tuple(max(1, round(given * float((y == c).mean()))) for c in (0, 1))

    def model(v: int) -> Logistic:
        xs, ys, ws = (np.concatenate(c) for c in zip(*sets[v], strict=True))
        return Logistic.fit(xs, ys, ws)

    models = (model(0), model(1))
    for _ in range(rounds):
        got = surest(pool, models, taken, amounts)
        if not len(got):
            break
        for v in (0, 1):
            mine = got[got["view"] == v].sort_values(["c", "sure", "twin"], ascending=[True, False, True])
            if len(mine):
                sets[1 - v].append((_views(mine)[1 - v], mine["c"].to_numpy(np.float64), np.full(len(mine), 0.5)))
        taken.update(got["twin"].tolist())
        models = (model(0), model(1))
    calm = held if len(np.unique(y[held])) == 2 else fit
    calibrated = tuple(Logistic.fit(models[v].logit(views[v][calm])[:, None], y[calm]) for v in (0, 1))
    both = np.stack([calibrated[v].logit(models[v].logit(views[v][calm])[:, None]) for v in (0, 1)], 1)
    return CoTrained(*models, calibrated, Logistic.fit(both, y[calm]))


def train(found: DataFrame, labels: DataFrame, labelled: int = LABELLED, given: int = GIVEN, rounds: int = ROUNDS) -> CoTrained | None:
    """Learns from features() and labels (doc_id, quality 0 or 1).

    Labels that are null or neither 0 nor 1 go; where a document has several, the lowest counts. Labelled documents,
    those beyond the sample too, are not in the pool of the rounds; documents without a doc_id are.
    """
    known = stored(labels.where("doc_id is not null and quality in (0, 1)").groupBy(F.col("doc_id").cast("bigint").alias("doc_id")).agg(F.min("quality").cast("double").alias("y")), "known")
    n = known.count()
    some = known if n <= labelled else known.where(F.pmod(F.xxhash64("doc_id", F.lit(7)), F.lit(1 << 20)) < int((1 << 20) * labelled / n))
    # about `labelled` rows at most on both sides: of rows that repeat a doc_id, one is learned from
    rows = found.join(F.broadcast(some), "doc_id").groupBy("doc_id").agg(F.min(F.struct("twin", "lang", "source", "n_chars", "x", "y")).alias("r")).select("doc_id", "r.*").toPandas()
    ids = known.select("doc_id")
    pool = found.join(F.broadcast(ids) if n <= BROADCAST_IDS else ids, "doc_id", "left_anti")
    return co_train(rows, stored(pool, "pool"), rounds, given)


# ---- scores -----------------------------------------------------------------------------------------------------
def _scores(model: CoTrained | None, x: np.ndarray, m: np.ndarray) -> pd.DataFrame:
    names = ["text_score", "meta_score", "score"]
    if model is None or not len(x):
        return pd.DataFrame(np.ones((len(x), 3)), columns=names)
    return pd.DataFrame(dict(zip(names, model.scores(x, m), strict=True)))


def scored(model: CoTrained | None, text: Column, lang: Column, source: Column, n_chars: Column) -> Column:
    """struct<text_score, meta_score, score> of a document. Without a model every score is 1."""

    @F.pandas_udf("text_score double, meta_score double, score double")
    def run(batches: Iterator[tuple[pd.Series, pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        release(forget=True)
        for t, l, s, n in batches:
            x = pd.Series([text_features(v) for v in t], dtype=object)
            yield _scores(model, *_views(pd.DataFrame({"x": x, "lang": l.to_numpy(), "source": s.to_numpy(), "n_chars": n.to_numpy()})))
        release()

    return run(text, lang.cast("string"), source.cast("string"), n_chars.cast("double"))


def classify(docs: DataFrame, labels: DataFrame, keep_from: float = KEEP_FROM, **how) -> DataFrame:
    """doc_id, text_score, meta_score, score, kept for every row; score is the probability of good quality.

    Null or empty text is scored as such; null metadata has marks of its own; null doc_id is carried and scored. Without
    labels of both classes there is nothing to tell apart: every score is 1 and all stay. Empty table: no rows.
    """
    found = features(docs)
    model = train(found, labels, **how)

    @F.pandas_udf("text_score double, meta_score double, score double")
    def run(x: pd.Series, l: pd.Series, s: pd.Series, n: pd.Series) -> pd.DataFrame:
        return _scores(model, *_views(pd.DataFrame({"x": x, "lang": l, "source": s, "n_chars": n})))

    return found.select("doc_id", run("x", "lang", "source", "n_chars").alias("q")).select("doc_id", "q.*", (F.col("q.score") >= keep_from).alias("kept"))


def op4_co_training(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


QUERIES = {"op4_co_training": op4_co_training}
ORACLES: dict[str, str] = {}
