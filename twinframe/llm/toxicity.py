"""Toxicity by a weighted lexicon, matched with an Aho-Corasick automaton.

Texts are folded first: lower case, look-alike letters of other scripts, full-width letters, digits and signs that
stand for letters (only beside letters); i, l and 1 become one letter. The lexicon, whole words and beginnings of
words, is learned from labelled texts: an entry's weight is the logarithm of how much likelier a toxic text has it.
A text's raw score is the sum of the weights of its hits, without those inside an exception phrase; the raw score
and the raw score per word (normalised by length) go through a logistic function fitted on the same texts.
"""

from __future__ import annotations

import math
import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._io import give_back, held_out, text_slices, train_rows, without

# Letters of other scripts that look like Latin ones, in pairs.
LOOKALIKES = "аaеeоoрpсcхxуyкkмmнhтtвbіiјjѕsԁdԛqԝwһhӏlαaβbεeικκkνvοoρpτtυuχxηnωwıiɡgɑa"
# Digits and signs that stand for letters.
DIGITS = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "9": "g"}
SIGNS = {"@": "a", "$": "s", "!": "i", "|": "i", "+": "t", "€": "e"}
# Phrases in which a word of the lexicon is harmless.
EXCEPTIONS = ["trash can", "trash bin", "trash bag", "trash collection", "clown fish", "circus clown", "pond scum", "sore loser", "idiot proof"]

WORD = re.compile(r"[^\W\d_]+")
SIGN_RUN = re.compile(r"(?<=[^\W\d_])[@$!|+€]+(?=[^\W\d_])|(?<!\S)[@$€]+(?=[^\W\d_])")
INNER_DIGITS = re.compile(r"(?<=[^\W\d_])[01345789]+|[01345789]+(?=[^\W\d_])")
PREFIXES = (3, 4, 5, 6)


def _table() -> dict[int, str]:
    pairs = {ord(LOOKALIKES[i]): LOOKALIKES[i + 1] for i in range(0, len(LOOKALIKES) - 1, 2) if ord(LOOKALIKES[i]) > 127 and ord(LOOKALIKES[i + 1]) < 128}
    pairs |= {0xFF41 + k: chr(97 + k) for k in range(26)} | {c: "" for c in (0xAD, 0x200B, 0x200C, 0x200D, 0x2060, 0xFEFF)}
    return {k: v.replace("l", "i") for k, v in pairs.items()} | {ord("l"): "i"}


FOLD = _table()


def fold(text: str) -> str:
    """The folded text."""
    t = text.lower()
    # digits and signs stand for letters only beside letters; the signs that follow a word are punctuation
    t = INNER_DIGITS.sub(lambda m: "".join(DIGITS[c] for c in m[0]), t)
    t = SIGN_RUN.sub(lambda m: "".join(SIGNS[c] for c in m[0]), t)
    return t.replace("l", "i") if t.isascii() else t.translate(FOLD)


def words_of(text: str | None) -> list[str]:
    return WORD.findall(fold(text)) if text else []


class Model:
    """entries: pattern -> weight. A pattern begins with a blank (a word's start); one that ends with a blank is a
    whole word. exceptions: folded phrases."""

    def __init__(self, entries: dict[str, float], exceptions: list[str], curve: tuple[float, float, float]):
        self.entries, self.exceptions, self.curve, self.automaton = entries, exceptions, curve, None

    def __reduce__(self):
        return Model, (self.entries, self.exceptions, self.curve)

    def _build(self) -> None:
        import ahocorasick

        self.automaton = ahocorasick.Automaton()
        for p, w in self.entries.items():
            self.automaton.add_word(p, (len(p), w))
        for p in self.exceptions:
            self.automaton.add_word(f" {p} ", (len(p) + 2, None))
        if len(self.automaton):
            self.automaton.make_automaton()

    def raw(self, words: list[str]) -> float:
        """Sum of the weights of the hits; of the hits on one word, the largest counts."""
        if self.automaton is None:
            self._build()
        if not words or not len(self.automaton):
            return 0.0
        hits: dict[int, float] = {}
        spared: set[int] = set()
        for end, (length, weight) in self.automaton.iter(f" {' '.join(words)} "):
            start = end - length + 1
            if weight is None:
                spared.update(range(start, end))
            elif weight > hits.get(start, 0.0):
                hits[start] = weight
        return sum(w for s, w in hits.items() if s not in spared)

    def measure(self, text: str | None) -> tuple[float, int]:
        words = words_of(text)
        return self.raw(words), len(words)

    def score(self, raw: float, n_words: int) -> float:
        a, b, c = self.curve
        z = a + b * math.log1p(raw) + c * math.log1p(100 * raw / (n_words + 20))
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, z))))


def _terms(words: list[str]) -> set[str]:
    out = set()
    for w in set(words):
        out.add(f" {w} ")
        for k in PREFIXES:
            if len(w) > k:
                out.add(f" {w[:k]}")
    return out


def choose(counts: list[tuple[str, int, int]], n_toxic: int, n_clean: int, least: float = 3.0, sigmas: float = 4.5) -> dict[str, float]:
    """Entries from (pattern, toxic texts with it, clean texts with it): far likelier in toxic texts (logarithm
    `least`) and not by chance (`sigmas`). An entry that a shorter one covers as well is left out."""
    share = n_toxic / max(1, n_toxic + n_clean)
    found = {}
    for term, a, b in counts:
        weight = math.log((a + 0.5) / (n_toxic + 1)) - math.log((b + 0.5) / (n_clean + 1))
        if weight >= least and a - (a + b) * share >= sigmas * math.sqrt((a + b) * share * (1 - share)):
            found[term] = weight
    # where one whole word makes up nearly all of a beginning's toxic texts, the word is the entry, not the beginning
    texts = {term: a for term, a, _ in counts}
    for term in [t for t in found if t.endswith(" ")]:
        for k in PREFIXES:
            if term[: k + 1] in found and texts[term] >= 0.9 * texts[term[: k + 1]]:
                del found[term[: k + 1]]
    kept: dict[str, float] = {}
    for term in sorted(found, key=lambda t: (len(t), t)):
        shorter = [kept[term[:k]] for k in range(2, len(term)) if term[:k] in kept]
        if not shorter or found[term] > max(shorter) + 1.0:
            kept[term] = found[term]
    return kept


def fit_curve(rows: list[tuple[float, int, int]], weights: tuple[float, float]) -> tuple[float, float, float]:
    """Logistic regression (Newton's method, a weak pull to zero) of the label on the two features."""
    x = np.array([[1.0, math.log1p(r), math.log1p(100 * r / (n + 20))] for r, n, _ in rows])
    y = np.array([label for _, _, label in rows], float)
    w = np.where(y > 0, weights[1], weights[0])
    beta = np.zeros(3)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        pull = np.array([0.01, 0.01, 0.01])
        step = np.linalg.solve((x * (w * p * (1 - p))[:, None]).T @ x + np.diag(pull), x.T @ (w * (y - p)) - pull * beta)
        beta += step
        if np.abs(step).max() < 1e-6:
            break
    return tuple(float(b) for b in beta)


def train(docs: DataFrame, labels: DataFrame, rows_per_class: int = 2500, exceptions: list[str] = EXCEPTIONS) -> Model:
    """A model from `docs` (doc_id, text) and `labels` (doc_id, toxic).

    Bound (the model is a classifier fitted on a sample): of each class the `rows_per_class` labelled documents with
    the smallest hashes. Rows without a label are not used; a document with several labels counts as toxic if one is.
    """
    spark = docs.sparkSession
    known = labels.where("toxic is not null and doc_id is not null").groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    sizes = {r["toxic"]: r["n"] for r in known.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not sizes.get(1) or not sizes.get(0):
        return Model({}, [], (math.log((sizes.get(1, 0) + 0.5) / (sizes.get(0, 0) + 0.5)), 0.0, 0.0))
    picked = [known.where(F.col("toxic") == c).orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows_per_class) for c in (0, 1)]
    some = docs.select("doc_id", "text").where("text is not null").join(F.broadcast(picked[0].unionByName(picked[1])), "doc_id").select("text", "toxic")

    def count(batches):
        found, n = (Counter(), Counter()), [0, 0]
        for batch in batches:
            for t, label in zip(batch.column("text").to_pylist(), batch.column("toxic").to_pylist()):
                found[label].update(_terms(words_of(t)))
                n[label] += 1
        terms = ["", *(found[0].keys() | found[1].keys())]  # '' holds the number of texts
        a = [n[1], *(found[1][t] for t in terms[1:])]
        b = [n[0], *(found[0][t] for t in terms[1:])]
        yield pa.RecordBatch.from_arrays([pa.array(terms, pa.string()), pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["term", "a", "b"])

    counts = some.mapInArrow(count, "term string, a bigint, b bigint").groupBy("term").agg(F.sum("a").alias("a"), F.sum("b").alias("b"))
    # a looser test than choose() makes keeps the rows that come to the driver to the promising ones: as all come from
    # rows_per_class texts, each in four of them, they are bounded by a quarter of these texts' words
    rows = counts.where("term = '' or a >= 4 and a > 2 * b").collect()
    n_toxic, n_clean = next(((r["a"], r["b"]) for r in rows if r["term"] == ""), (0, 0))
    entries = choose([(r["term"], r["a"], r["b"]) for r in rows if r["term"]], n_toxic, n_clean)
    phrases = [" ".join(words_of(p)) for p in exceptions]
    model = Model(entries, [p for p in phrases if p], (0.0, 0.0, 0.0))
    shared = spark.sparkContext.broadcast(model)

    def measure(batches):
        for batch in batches:
            m = [shared.value.measure(t) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in m], pa.float64()), pa.array([x[1] for x in m], pa.int64()), batch.column("toxic")], names=["raw", "n", "toxic"])

    seen = [(r["raw"], r["n"], r["toxic"]) for r in some.mapInArrow(measure, "raw double, n bigint, toxic int").collect()]
    del rows, counts
    give_back()
    n1 = max(1, sum(label for _, _, label in seen))
    n0 = max(1, len(seen) - n1)
    return Model(entries, model.exceptions, fit_curve(seen, (sizes[0] / n0 / 10, sizes[1] / n1 / 10)) if seen else (0.0, 0.0, 0.0))


def score(df: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """`df` with score (0 to 1), predicted (1 if the score is 0.7 or more) and n_words.

    Null and empty texts get the score of a text without hits. Columns of these names are replaced.
    """
    keep = without(df, "score", "predicted", "n_words")
    base = df.select(*[df[c] for c in keep])
    shared = df.sparkSession.sparkContext.broadcast(model)  # the lexicon: bounded by the words of the texts that it was learned from

    def each(batches):
        for batch in batches:
            m = shared.value
            column, found = batch.column(batch.schema.names.index(text)), []
            for start, end in text_slices(column):
                found += [m.measure(t) for t in column.slice(start, end - start).to_pylist()]
            scores = [m.score(*x) for x in found]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(scores, pa.float64()), pa.array([int(s >= 0.7) for s in scores], pa.int32()), pa.array([x[1] for x in found], pa.int64())], names=[*batch.schema.names, "score", "predicted", "n_words"])
        give_back()

    extra = [T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType()), T.StructField("n_words", T.LongType())]
    return base.mapInArrow(each, T.StructType([*base.schema.fields, *extra]))


def query(docs: DataFrame, labels: DataFrame) -> DataFrame:
    model = train(docs, train_rows(labels))
    return score(docs.select("doc_id", "text"), model).select("doc_id", held_out().alias("held_out"), "score", "predicted")
