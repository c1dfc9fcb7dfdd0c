"""Language identification of mixed texts: script ranges, word scores, Viterbi with a switching penalty.

Learning counts character n-grams of words by language in the executors; the model is a table of a fixed number of
hashed n-grams by languages, whatever the corpus. The script of a word's letters narrows its candidates to the
languages that were seen to use that script. A word's score for a language is the log probability of its n-grams. Over
the words of a text, Viterbi finds the path of languages of the highest score, where each change of language costs a
penalty: runs of one language are the spans. The language with the most letters in its spans is the text's.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenweft.llm._common import small_batches, table

#: About so many labelled documents are learned from (a bounded sample, by a hash of doc_id).
TRAIN_DOCUMENTS = 20_000
BUCKET_BITS = 15
BUCKETS = 1 << BUCKET_BITS
NGRAMS = (1, 2, 3)
SWITCH = 12.0
#: A language with a smaller share of a script's letters is no candidate for its words.
SCRIPT_SHARE = 0.001
UNKNOWN = "und"
#: Words that a worker remembers; then it forgets all and starts anew. Bounds memory, not results.
MEMO_ENTRIES = 600_000

#: First and last code points of script ranges (Unicode blocks; fixed values).
SCRIPTS = (
    ("latin", ((0x41, 0x5A), (0x61, 0x7A), (0xAA, 0xAA), (0xBA, 0xBA), (0xC0, 0x24F), (0x250, 0x2AF), (0x1E00, 0x1EFF), (0x2C60, 0x2C7F), (0xA720, 0xA7FF), (0xFB00, 0xFB06), (0xFF21, 0xFF5A))),
    ("greek", ((0x370, 0x3FF), (0x1F00, 0x1FFF))),
    ("cyrillic", ((0x400, 0x52F), (0x1C80, 0x1C8F), (0x2DE0, 0x2DFF), (0xA640, 0xA69F))),
    ("armenian", ((0x530, 0x58F),)),
    ("hebrew", ((0x590, 0x5FF), (0xFB1D, 0xFB4F))),
    ("arabic", ((0x600, 0x6FF), (0x750, 0x77F), (0x8A0, 0x8FF), (0xFB50, 0xFDFF), (0xFE70, 0xFEFF))),
    ("devanagari", ((0x900, 0x97F),)),
    ("bengali", ((0x980, 0x9FF),)),
    ("tamil", ((0xB80, 0xBFF),)),
    ("thai", ((0xE00, 0xE7F),)),
    ("georgian", ((0x10A0, 0x10FF), (0x1C90, 0x1CBF), (0x2D00, 0x2D2F))),
    ("hangul", ((0x1100, 0x11FF), (0x3130, 0x318F), (0xAC00, 0xD7AF))),
    ("kana", ((0x3040, 0x30FF), (0x31F0, 0x31FF), (0xFF66, 0xFF9F))),
    ("han", ((0x2E80, 0x2FDF), (0x3400, 0x4DBF), (0x4E00, 0x9FFF), (0xF900, 0xFAFF), (0x20000, 0x3FFFF))),
)
OTHER = len(SCRIPTS)
_BOUNDS = sorted((lo, hi, k) for k, (_, ranges) in enumerate(SCRIPTS) for lo, hi in ranges)
_LOWS, _HIGHS, _KINDS = (np.array(c, np.int64) for c in zip(*_BOUNDS, strict=True))
#: Letters and the like: what is a word character but no decimal digit and no underscore.
WORD = re.compile(r"[^\W\d_]+")


def words(text: str) -> list[str]:
    """Runs of letters, in lower case."""
    return WORD.findall(text.lower())


def letters(word: str) -> str:
    """A word without the numerals that the pattern for words lets through."""
    return word if word.isalpha() else "".join(filter(str.isalpha, word))


def ngrams(found: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(buckets, number of the word) of all n-grams of the words, for each n, with marks at both ends of a word."""
    sizes = np.fromiter(map(len, found), np.int64, len(found)) + 2
    code = np.frombuffer("".join([f"\x02{w}\x03" for w in found]).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    owner = np.repeat(np.arange(len(found)), sizes)
    for n in NGRAMS:
        if len(code) < n:
            continue
        h = code[: len(code) - n + 1].copy()
        for j in range(1, n):
            h = h * np.uint64(0x100000001B3) + code[j : len(code) - n + 1 + j]
        ok = owner[: len(h)] == owner[n - 1 :]
        if n == 1:
            ok &= code > 3  # the marks alone say nothing
        yield ((h[ok] * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - BUCKET_BITS)).astype(np.int64), owner[: len(h)][ok]


def scripts(found: list[str]) -> np.ndarray:
    """The script of each word, by its first letter."""
    first = np.fromiter((ord(w[0]) for w in found), np.int64, len(found))
    at = np.maximum(np.searchsorted(_LOWS, first, side="right") - 1, 0)
    return np.where((first >= _LOWS[at]) & (first <= _HIGHS[at]), _KINDS[at], OTHER)


@dataclass
class Model:
    languages: list[str]
    table: np.ndarray  # buckets x languages: log probabilities
    allowed: np.ndarray  # scripts x languages
    switch: float = SWITCH

    def __post_init__(self) -> None:
        self.memo: dict[str, int] = {}
        self.rows = np.zeros((1024, len(self.languages)), np.float32)
        self.sizes = np.zeros(1024, np.int32)

    def meet(self, new: list[str]) -> None:
        """Scores words that have not been met, all at once."""
        real = [letters(w) for w in new]
        kept = [i for i, w in enumerate(real) if w]
        at = len(self.memo)
        self.memo.update((w, -1) for w in new)
        if not kept:
            return
        found = [real[i] for i in kept]
        while at + len(new) > len(self.rows):
            self.rows = np.concatenate([self.rows, np.zeros_like(self.rows)])
            self.sizes = np.concatenate([self.sizes, np.zeros_like(self.sizes)])
        total = np.zeros((len(found), len(self.languages)))
        for buckets, owner in ngrams(found):
            for k in range(total.shape[1]):
                total[:, k] += np.bincount(owner, weights=self.table[:, k][buckets], minlength=len(found))
        ok = self.allowed[scripts(found)]
        ok |= ~ok.any(1, keepdims=True)
        total = np.where(ok, total, total.min(1, keepdims=True) - 50.0)
        self.rows[at : at + len(found)] = total - total.max(1, keepdims=True)
        self.sizes[at : at + len(found)] = [len(w) for w in found]
        self.memo.update((new[i], at + j) for j, i in enumerate(kept))

    def look_up(self, texts: list[str | None]) -> list[tuple[np.ndarray, np.ndarray]]:
        """(scores by language, number of letters) of each word with letters, for each text."""
        if len(self.memo) > MEMO_ENTRIES:
            self.memo.clear()
        raws = [words(t or "") for t in texts]
        new = set(chain.from_iterable(raws)).difference(self.memo)
        if new:
            self.meet(list(new))
        out = []
        for r in raws:
            at = np.fromiter(map(self.memo.__getitem__, r), np.int64, len(r))
            at = at[at >= 0]
            out.append((self.rows[at], self.sizes[at]))
        return out

    def constant(self, scores: np.ndarray) -> int | None:
        """The language of the whole text, if no stretch of words could pay for a change to others and back; else None.

        The gain of any detour is at most the sum of the best other scores over its own; inside of a text a detour costs
        two changes, at its begin or end one.
        """
        if scores.shape[1] == 1:
            return 0
        k = int(scores.sum(0).argmax())
        gain = np.delete(scores, k, axis=1).max(1).astype(np.float64) - scores[:, k]
        sums = np.cumsum(gain)
        before = np.concatenate([[0.0], sums[:-1]])
        inside = (sums - np.minimum.accumulate(before)).max()
        edge = max(sums.max(), (sums[-1] - before).max())
        return k if inside <= 2 * self.switch and edge <= self.switch else None

    def paths(self, texts: list[np.ndarray]) -> list[np.ndarray]:
        """For each text the language of each of its words. Viterbi runs over all texts of the batch at once, word by word."""
        kind = np.int16 if len(self.languages) <= np.iinfo(np.int16).max else np.int32
        out: list[np.ndarray] = [np.zeros(0, kind)] * len(texts)
        mixed = []
        for i, x in enumerate(texts):
            if len(x):
                k = self.constant(x)
                if k is None:
                    mixed.append(i)
                else:
                    out[i] = np.full(len(x), k, kind)
        order = sorted(mixed, key=lambda i: -len(texts[i]))
        if not order:
            return out
        n_words = np.array([len(texts[i]) for i in order], np.int64)
        count = len(self.languages)
        steps = int(n_words[0])
        begins = np.concatenate([[0], np.cumsum(n_words)])
        scores = np.concatenate([texts[i] for i in order])
        active = np.searchsorted(-n_words, -np.arange(1, steps + 1), side="right")  # texts with a word t
        rows = begins[:-1]
        best = scores[rows].astype(np.float64)
        back = np.zeros((int(begins[-1]), count), kind)
        own = np.arange(count, dtype=kind)
        for t in range(1, steps):
            a = active[t]
            now = best[:a]
            top = now.argmax(1)
            leave = now.max(1) - self.switch
            stay = now >= leave[:, None]
            back[rows[:a] + t] = np.where(stay, own, top[:, None])
            best[:a] = np.where(stay, now, leave[:, None]) + scores[rows[:a] + t]
        path = np.zeros(int(begins[-1]), kind)
        state = best.argmax(1).astype(kind)
        for t in range(steps - 1, -1, -1):
            a = active[t]
            path[rows[:a] + t] = state[:a]
            if t:
                state[:a] = back[rows[:a] + t, state[:a]]
        for k, i in enumerate(order):
            out[i] = path[begins[k] : begins[k + 1]]
        return out


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def learn(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang", most: int = TRAIN_DOCUMENTS, switch: float = SWITCH) -> Model | None:
    """A model from about `most` of the documents with a language and a text, by a hash of doc_id; None if there are none.

    Counts are summed in the executors; BUCKETS rows a language come to the driver.
    """
    small_batches(docs.sparkSession)
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"), F.col(lang).alias("lang")).where("lang is not null and text is not null")
    total = rows.count()
    if not total:
        return None
    if total > most:
        rows = rows.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) < int((1 << 20) * most / total) + 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[str, Counter] = {}
        for batch in batches:
            for text, lang in zip(batch.column("text").to_pylist(), batch.column("lang").to_pylist(), strict=True):
                seen.setdefault(lang, Counter()).update(words(text))
        for lang, counter in seen.items():
            grams, by_script = np.zeros(BUCKETS), np.zeros(OTHER + 1)
            pairs = [(w, c) for raw, c in counter.items() if (w := letters(raw))]
            if not pairs:
                continue
            found, times = [w for w, _ in pairs], np.array([c for _, c in pairs], np.float64)
            for buckets, owner in ngrams(found):
                grams += np.bincount(buckets, weights=times[owner], minlength=BUCKETS)
            by_script += np.bincount(scripts(found), weights=times * [len(w) for w in found], minlength=OTHER + 1)
            both = np.concatenate([grams, by_script])
            at = np.flatnonzero(both)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at), pa.string()), pa.array(at, pa.int64()), pa.array(both[at], pa.float64())], ["lang", "k", "c"])

    sums = rows.mapInArrow(run, "lang string, k bigint, c double").groupBy("lang", "k").agg(F.sum("c").alias("c")).toPandas()
    languages = sorted(sums["lang"].unique())
    if not languages:
        return None
    counts = np.zeros((BUCKETS + OTHER + 1, len(languages)))
    counts[sums["k"].to_numpy(), sums["lang"].map({x: i for i, x in enumerate(languages)}).to_numpy()] = sums["c"].to_numpy()
    grams, letters_in = counts[:BUCKETS] + 0.1, counts[BUCKETS:]
    share = letters_in / np.maximum(letters_in.sum(0), 1)
    return Model(languages, np.log(grams / grams.sum(0)).astype(np.float32), share >= SCRIPT_SHARE, switch)


def spans(path: np.ndarray) -> list[tuple[int, int, int]]:
    """(language, first word, end) of the runs of one language."""
    cuts = [0, *(np.flatnonzero(np.diff(path)) + 1).tolist(), len(path)]
    return [(int(path[a]), a, b) for a, b in zip(cuts, cuts[1:], strict=False) if a < b]


def identify(docs: DataFrame, model: Model | None, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, lang_pred, score, spans (lang:first:end of the words with letters) for every row, from the whole text.

    score: the share of the text's letters in its language's spans. A text that is null or has no letter, and any text
    where nothing could be learned: und, 0, no spans. Ties go to the first language by name. Null doc_id is carried.
    """
    spark = docs.sparkSession
    small_batches(spark)
    shared = spark.sparkContext.broadcast(model)  # BUCKETS x languages floats

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in batches:
            texts = batch.column(1).to_pylist()
            looked = m.look_up(texts) if m is not None else []
            names, scores, found = [], [], []
            for (_, sizes), path in zip(looked, m.paths([x for x, _ in looked]), strict=True) if m is not None else [(((), ()), ())] * len(texts):
                if not len(path):
                    names.append(UNKNOWN)
                    scores.append(0.0)
                    found.append("")
                    continue
                mass = np.bincount(path, weights=sizes, minlength=len(m.languages))
                names.append(m.languages[int(mass.argmax())])
                scores.append(float(mass.max() / mass.sum()))
                found.append(" ".join(f"{m.languages[k]}:{a}:{b}" for k, a, b in spans(path)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(names, pa.string()), pa.array(scores, pa.float64()), pa.array(found, pa.string())], ["doc_id", "lang_pred", "score", "spans"])

    rows = docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.col(text).alias("text"))
    return rows.mapInArrow(run, "doc_id bigint, lang_pred string, score double, spans string")


def op9_viterbi_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = learn(docs.where(~held_out(F.col("doc_id"))))
    return identify(docs, model).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")


QUERIES = {"op9_viterbi_language": op9_viterbi_language}
ORACLES: dict[str, str] = {}
