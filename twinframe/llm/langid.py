"""Language identification by segmentation-marginalised unigrams.

The vocabulary of pieces is a fixed public one. Each language has a probability for every piece, and the probability
of a word is the sum, over all ways to cut it into pieces, of the product of the pieces' probabilities; a forward
recursion over the word's letters adds these up. The text's score for a language is the sum of its words' logarithms.
Piece probabilities are learned by expectation-maximisation (expected piece counts over all cuts of a word).

The model is fitted on the driver from a bounded table of words: at most `train_rows` texts a language, chosen by a
hash of the text, and their `train_words` most frequent words. Everything else covers every whole text.
"""

from __future__ import annotations

import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window

from ._io import give_back, held_out, text_slices, train_rows, without

LETTERS = re.compile(r"[^\W\d_]+")
LONGEST_FIT = 64  # letters; longer words do not take part in the fit
ROWS = 320_000  # letters of the words that are scored at once
FLOOR, UNKNOWN = 0.1, 1e-9  # pseudo-count of every piece; probability of a letter that is no piece
CACHE = 200_000


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def pieces(path: str | None = None) -> list[str]:
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=path or default_vocabulary())
    found = (sp.id_to_piece(i) for i in range(sp.get_piece_size()) if not (sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i)))
    return [p for p in found if LETTERS.fullmatch(p.lstrip("▁")) and p == p.lower()]


def words_of(text: str | None) -> list[str]:
    """The words of a text, runs of letters in lower case; their order does not count."""
    words = LETTERS.findall((text or "").lower())
    if all(map(str.isalpha, words)):
        return words
    # numbers that are no digits are no letters either
    return [w for w in words if w.isalpha()] + [w for word in words if not word.isalpha() for w in "".join(c if c.isalpha() else " " for c in word).split()]


class Lattice:
    """Finds the pieces of many words at once. Substrings are compared by a 64-bit hash."""

    MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)

    def __init__(self, vocabulary: list[str]):
        self.longest = max(map(len, vocabulary))
        hashes = np.array([self._hash(p) for p in vocabulary], np.uint64)
        self.order = np.argsort(hashes)
        self.sorted = hashes[self.order]
        self.sieve = np.zeros(1 << 20, bool)  # tells most substrings that are no piece at once
        self.sieve[(self.sorted >> np.uint64(44)).astype(np.int64)] = True

    def _hash(self, text: str) -> int:
        h = np.zeros(1, np.uint64)
        for c in text:
            h = (h + np.uint64(ord(c) + 1)) * self.MULTIPLIER
            h ^= h >> np.uint64(29)
        return int(h[0])

    def find(self, codes: np.ndarray):
        """codes: words of one length, a row each. Yields (start, end, rows, pieces) with the words that have a piece there."""
        n, length = codes.shape
        for start in range(length):
            h = np.zeros(n, np.uint64)
            for end in range(start + 1, min(length, start + self.longest) + 1):
                h = (h + codes[:, end - 1] + np.uint64(1)) * self.MULTIPLIER
                h ^= h >> np.uint64(29)
                rows = np.flatnonzero(self.sieve[(h >> np.uint64(44)).astype(np.int64)])
                if len(rows):
                    at = np.minimum(np.searchsorted(self.sorted, h[rows]), len(self.sorted) - 1)
                    hit = self.sorted[at] == h[rows]
                    if hit.any():
                        yield start, end, rows[hit], self.order[at[hit]]


def _codes(words: list[str]) -> np.ndarray:
    return np.frombuffer("".join("▁" + w for w in words).encode("utf-32-le"), "<u4").reshape(len(words), -1).astype(np.uint64)


def by_length(words: list[str]):
    """(indices, codes) for each length."""
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    for n in np.unique(lengths):
        rows = np.flatnonzero(lengths == n)
        yield rows, _codes([words[i] for i in rows])


class Model:
    def __init__(self, languages: list[str], vocabulary: list[str], probability: np.ndarray):
        self.languages, self.vocabulary, self.p = languages, vocabulary, probability
        self.lattice = Lattice(vocabulary) if vocabulary else None
        self.cache: dict[str, int] = {}
        self.rows = np.zeros((0, len(languages)))

    def __reduce__(self):
        return Model, (self.languages, self.vocabulary, self.p)

    def word_scores(self, words: list[str]) -> np.ndarray:
        """log probability of each word (all cuts summed) for each language."""
        out = np.zeros((len(words), len(self.languages)))
        for rows, codes in by_length(words):
            step = max(1, ROWS // codes.shape[1])
            for k in range(0, len(rows), step):
                out[rows[k : k + step]] = self._forward(codes[k : k + step])
        return out

    def _forward(self, codes: np.ndarray) -> np.ndarray:
        n, length = codes.shape
        alpha = np.zeros((length + 1, n, len(self.languages)))
        alpha[0] = 1.0
        scale = np.zeros((n, len(self.languages)))
        done = 0

        def settle(upto: int):
            # all pieces that end at `upto` or before are in; a letter may also be read as unknown
            nonlocal done
            while done < upto:
                alpha[done + 1] += alpha[done] * UNKNOWN
                done += 1
                if done % 16 == 0 and done < length:  # keeps long words above the smallest floating-point numbers
                    top = np.maximum(alpha[done : done + 1].max(axis=0), 1e-300)
                    alpha[done : done + self.lattice.longest + 1] /= top  # arcs from here on reach no further
                    scale[:] += np.log(top)

        for start, end, rows, piece in self.lattice.find(codes):
            settle(start)
            alpha[end, rows] += alpha[start, rows] * self.p[piece]
        settle(length)
        return np.log(np.maximum(alpha[length], 1e-300)) + scale

    def scores(self, texts: list[list[str]]) -> np.ndarray:
        """Sum of the words' scores for each text."""
        if len(self.cache) > CACHE:
            self.forget()
        flat = [w for t in texts for w in t]
        fresh = list({w for w in flat if w not in self.cache}) if flat else []
        if fresh:
            for w in fresh:
                self.cache[w] = len(self.cache)
            self.rows = np.concatenate([self.rows, self.word_scores(fresh)])
        at = np.fromiter(map(self.cache.__getitem__, flat), np.int64, len(flat))
        sums = np.concatenate([np.zeros((1, len(self.languages))), np.cumsum(self.rows[at], axis=0)])
        ends = np.cumsum([len(t) for t in texts])
        return sums[ends] - sums[np.concatenate([[0], ends[:-1]]).astype(np.int64)]

    def forget(self) -> None:
        """Drops the words' kept scores; an idle worker should not hold them."""
        self.cache, self.rows = {}, np.zeros((0, len(self.languages)))

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
        words = [words_of(t) for t in texts]
        if not self.languages:
            return ["und"] * len(texts), np.zeros(len(texts))
        s = self.scores(words) if words else np.zeros((0, len(self.languages)))
        best = s.argmax(axis=1)
        share = 1 / np.exp(s - s.max(axis=1, keepdims=True)).sum(axis=1)
        known = np.array([bool(w) for w in words], bool)
        return [self.languages[b] if k else "und" for b, k in zip(best, known)], np.where(known, share, 0.0)


def fit(counts: dict[str, dict[str, int]], vocabulary: list[str], rounds: int = 3) -> Model:
    """Expectation-maximisation of the piece probabilities; counts: language -> word -> occurrences."""
    languages = sorted(counts)
    words = sorted({w for c in counts.values() for w in c})
    weight = np.array([[counts[x].get(w, 0) for x in languages] for w in words], float).reshape(len(words), len(languages))
    lattice = Lattice(vocabulary) if vocabulary else None
    p = np.full((len(vocabulary), len(languages)), 1 / max(1, len(vocabulary)))
    arcs = []
    for rows, codes in by_length(words) if words else ():
        arcs.append((rows, codes.shape[1], list(lattice.find(codes))))
    for _ in range(rounds):
        expected = np.full_like(p, FLOOR)
        for rows, length, found in arcs:
            n = len(rows)
            alpha, beta = np.zeros((length + 1, n, len(languages))), np.zeros((length + 1, n, len(languages)))
            alpha[0] = beta[length] = 1.0
            ends = 0
            for start, end, r, piece in found:
                while ends < start:
                    alpha[ends + 1] += alpha[ends] * UNKNOWN
                    ends += 1
                alpha[end, r] += alpha[start, r] * p[piece]
            while ends < length:
                alpha[ends + 1] += alpha[ends] * UNKNOWN
                ends += 1
            starts = length
            for start, end, r, piece in reversed(found):
                while starts > start + 1:
                    beta[starts - 1] += beta[starts] * UNKNOWN
                    starts -= 1
                beta[start, r] += beta[end, r] * p[piece]
            whole = np.maximum(alpha[length], 1e-300)
            for start, end, r, piece in found:
                share = alpha[start, r] * p[piece] * beta[end, r] / whole[r] * weight[rows[r]]
                np.add.at(expected, piece, share)
        p = expected / expected.sum(axis=0)
    return Model(languages, vocabulary, p)


def train(df: DataFrame, text: str = "text", lang: str = "lang", vocabulary: str | None = None, train_rows_per_lang: int = 800, train_words: int = 6000, rounds: int = 3) -> Model:
    """A model from the rows of `df` whose text and language are not null.

    Bounds (the model is a classifier fitted on a sample): `train_rows_per_lang` different texts a language, those with the
    smallest hashes, and of each language's words of at most LONGEST_FIT letters the `train_words` most frequent.
    """
    rows = df.where(F.col(text).isNotNull() & F.col(lang).isNotNull()).select(F.col(lang).cast("string").alias("lang"), F.col(text).alias("text"), F.xxhash64(text).alias("h"))
    # the bar comes from narrow rows: the hash below which about the wanted number of rows lies, with room for twice as many
    bar = rows.groupBy("lang").agg(F.approx_count_distinct("h").alias("n"))
    shares = {r["lang"]: min(1.0, 2.0 * train_rows_per_lang / r["n"]) for r in bar.collect()}
    if not shares:
        return Model([], [], np.zeros((0, 0)))
    limit = F.lit(None).cast("double")
    for name, share in shares.items():
        limit = F.when(F.col("lang") == name, F.lit(share)).otherwise(limit)
    some = rows.where(F.pmod("h", F.lit(1 << 20)) < limit * (1 << 20)).dropDuplicates(["lang", "h"])  # copies count once
    some = some.withColumn("k", F.row_number().over(Window.partitionBy("lang").orderBy("h"))).where(F.col("k") <= train_rows_per_lang)

    def count(batches):
        found: dict[str, Counter] = {}
        for batch in batches:
            for name, t in zip(batch.column("lang").to_pylist(), batch.column("text").to_pylist()):
                found.setdefault(name, Counter()).update(w for w in words_of(t) if len(w) <= LONGEST_FIT)
        out = [(name, w, n) for name, c in found.items() for w, n in c.items()]
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*out)], names=["lang", "word", "n"])

    words = some.select("lang", "text").mapInArrow(count, "lang string, word string, n bigint").groupBy("lang", "word").agg(F.sum("n").alias("n"))
    top = Window.partitionBy("lang").orderBy(F.desc("n"), "word")
    counts: dict[str, dict[str, int]] = {}
    for r in words.withColumn("k", F.row_number().over(top)).where(F.col("k") <= train_words).collect():
        counts.setdefault(r["lang"], {})[r["word"]] = r["n"]
    model = fit(counts, pieces(vocabulary), rounds)
    give_back()
    return model


def predict(df: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """`df` with lang_pred (a learned language; `und` if the text is null or has no letters) and score (0 to 1: the
    language's share of the probability, all languages equally likely beforehand; 0 for `und`).

    Equal scores go to the alphabetically first language. Columns of these names are replaced.
    """
    keep = without(df, "lang_pred", "score")
    base = df.select(*[df[c] for c in keep])
    shared = df.sparkSession.sparkContext.broadcast(model)  # vocabulary size x languages numbers

    def each(batches):
        for batch in batches:
            texts = batch.column(batch.schema.names.index(text))
            langs, scores = [], []
            for start, end in text_slices(texts):
                a, b = shared.value.predict(texts.slice(start, end - start).to_pylist())
                langs += a
                scores.append(b)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(langs, pa.string()), pa.array(np.concatenate(scores) if scores else [], pa.float64())], names=[*batch.schema.names, "lang_pred", "score"])
        shared.value.forget()
        give_back()

    return base.mapInArrow(each, T.StructType([*base.schema.fields, T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())]))


def query(docs: DataFrame) -> DataFrame:
    model = train(train_rows(docs))
    return predict(docs.select("doc_id", "text"), model).select("doc_id", held_out().alias("held_out"), "lang_pred", "score")
