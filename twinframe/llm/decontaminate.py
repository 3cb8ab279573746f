"""Benchmark decontamination by latent semantic retrieval.

Benchmark items and document passages become TF-IDF vectors over the benchmark's words (a word that no item has can't
raise a passage's likeness to one). A randomised SVD, computed by tasks over a passage sample and all items, gives a
latent space of `rank` dimensions. Every document is cut into segments of `segment` words; passages are `span`
segments long and start at every segment, over whole texts. A list of items for each term gives the pairs of passages
and items that have two terms in common (one, if the item has one); only they are compared, not every passage with every
item. Pairs whose cosine is `cosine` or more are candidates, and so are, whatever their cosine, pairs that share half of the
terms of the item's passage (all, if the item must occur word for word): an item that stands in a text word for word
is a candidate at one of its passages at least, however short it is and whatever stands around it. For candidates, the
longest common subsequence of the item's words and the words around the passage is found. An item counts as contained if that covers `exact` of its words; or, as a
paraphrase, `similar` of them if the answer check holds too: the answer's words, or without an answer `key_share` of the
item's rarest quarter of words, stand in the passage.

Bounds: document frequencies count every document; the SVD, an index, is fitted on all items and on at most
`fit_rows` documents of at most 65,536 characters. A benchmark of more than `max_items` items or `max_words` words is
taken in slices, each with its own index, so that what is broadcast stays below max_words x rank numbers.
"""

from __future__ import annotations

import re
from collections import Counter
from functools import reduce
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._io import give_back, text_slices, without, written

WORD = re.compile(r"\w+")
PIECE = 1024  # segments, or passages, whose vectors a worker holds at once


class Settings:
    """segment, span: words of a segment, segments of a passage. rank: dimensions. cosine: least likeness of a
    candidate that shares few terms. exact, similar: shares of an item's words. min_words: shorter items must occur word for word.
    max_df: words in a larger share of the documents are not terms, but for the `rarest` of each item. max_items,
    max_words: of one index; a larger benchmark has several."""

    def __init__(self, segment: int = 16, span: int = 3, rank: int = 256, cosine: float = 0.35, max_df: float = 0.05, rarest: int = 8, exact: float = 0.75, similar: float = 0.5, min_words: int = 8, max_items: int = 5000, max_words: int = 100_000, fit_rows: int = 2000, seed: int = 1, key_share: float = 0.4):
        self.segment, self.span, self.rank, self.cosine, self.exact, self.similar = segment, span, rank, cosine, exact, similar
        self.max_df, self.rarest = max_df, rarest
        self.min_words, self.max_items, self.max_words, self.fit_rows, self.seed, self.key_share = min_words, max_items, max_words, fit_rows, seed, key_share


def words_of(text: str | None) -> list[str]:
    return WORD.findall(text.lower()) if text else []


def lcs(a: list[str], b: list[str]) -> tuple[int, int, int]:
    """Length of the longest common subsequence and the range of b in which it grew (bit-parallel over a)."""
    masks: dict[str, int] = {}
    for i, w in enumerate(a):
        masks[w] = masks.get(w, 0) | 1 << i
    full = (1 << len(a)) - 1
    v, length, first, last = full, 0, len(b), -1
    for j, w in enumerate(b):
        m = masks.get(w)
        if m is None:
            continue
        u = v & m
        v = (v + u | v - u) & full
        now = len(a) - v.bit_count()
        if now > length:
            length, last = now, j
            first = min(first, j)
    return length, first, last


class Index:
    """Items in latent space, and what finding and checking them needs."""

    def __init__(self, settings: Settings, vocabulary: dict[str, int], idf: np.ndarray, vectors: np.ndarray, items: list[tuple[int, list[str], list[str], str | None]]):
        self.s, self.vocabulary, self.idf, self.vectors, self.items = settings, vocabulary, idf, vectors, items
        self.weighted = (vectors * idf[:, None]).astype(np.float32)
        rows, self.item_of, holders = [], [], []
        size = settings.segment * settings.span
        for k, (_, words, _, _) in enumerate(items):
            for start in range(0, max(1, len(words) - size // 2), size):  # a long item has several passages
                # a passage without terms keeps a zero row, which nothing is like
                ids = [vocabulary[w] for w in words[start : start + size] if w in vocabulary]
                rows.append(self.weighted[ids].sum(axis=0))
                holders.append(np.unique(np.array(ids, np.int64)))
                self.item_of.append(k)
        r = np.array(rows, np.float32).reshape(len(rows), vectors.shape[1])
        self.rows = r / np.maximum(np.linalg.norm(r, axis=1, keepdims=True), 1e-12)
        # the items' passages that hold a term: self.held[self.first[term] : self.first[term + 1]]
        terms = np.concatenate([np.zeros(0, np.int64), *holders])
        order = np.argsort(terms, kind="stable")
        self.held = np.repeat(np.arange(len(rows)), [len(h) for h in holders])[order]
        self.first = np.searchsorted(terms[order], np.arange(len(vocabulary) + 1))
        self.least = np.array([min(2, len(h)) for h in holders], np.int64)  # one term is evidence only if there is no other
        # with so many terms in common a pair needs no likeness. Passages begin at every segment, so an item that stands in
        # a text lies in one passage if it's short, and otherwise in two, one of which has half of its terms
        whole = [len(items[k][1]) < min(settings.min_words, size - settings.segment + 2) for k in self.item_of]
        self.enough = np.array([len(h) if w else -(-len(h) // 2) for h, w in zip(holders, whole)], np.int64)

    def __reduce__(self):
        return Index, (self.s, self.vocabulary, self.idf, self.vectors, self.items)

    def search(self, texts: list[str | None]) -> list[tuple[int, int, float, int, int]]:
        """(row, item, cosine, common words, item's words) of every item found in every text."""
        s, get, found = self.s, self.vocabulary.get, []
        if not self.items:
            return found
        words = [words_of(t) for t in texts]
        segments = [-(-len(w) // s.segment) for w in words]
        total = sum(segments)
        if not total:
            return found
        offset = np.concatenate([[0], np.cumsum(segments)])
        ids, where = [], []
        for k, w in enumerate(words):
            if w:
                i = np.fromiter(map(get, w, repeat(-1)), np.int32, len(w))
                at = np.flatnonzero(i >= 0)
                ids.append(i[at])
                where.append(offset[k] + at // s.segment)
        ids, where = np.concatenate(ids), np.concatenate(where)
        if not len(ids):
            return found
        doc_of = np.repeat(np.arange(len(words)), segments)
        passages, items, shared = self._shared(ids, where, doc_of)
        if not len(passages):
            return found
        # vectors are made for these passages only, from the vectors of their segments
        rows, at = np.unique(passages, return_inverse=True)
        parts = rows[:, None] + np.arange(s.span)
        inside = (parts < total) & (doc_of[np.minimum(parts, total - 1)] == doc_of[rows][:, None])  # a passage ends with its document
        need = np.zeros(total, bool)
        need[parts[inside]] = True
        place = np.cumsum(need) - 1
        keep = need[where]
        ids, where = ids[keep], place[where[keep]]
        latent = np.zeros((int(need.sum()) + 1, self.weighted.shape[1]), np.float32)
        edge = np.flatnonzero(np.concatenate([[True], where[1:] != where[:-1]]))
        for a in range(0, len(edge), PIECE):  # bounded pieces of the gathered vectors
            e = edge[a : a + PIECE]
            stop = edge[a + PIECE] if a + PIECE < len(edge) else len(ids)
            latent[where[e]] = np.add.reduceat(self.weighted[ids[e[0] : stop]], e - e[0], axis=0)
        parts = np.where(inside, place[np.minimum(parts, total - 1)], len(latent) - 1)
        best: dict[tuple[int, int], tuple[float, int, int]] = {}
        ends = np.searchsorted(at, np.arange(0, len(rows) + PIECE, PIECE))  # pairs are sorted by passage
        for n, a in enumerate(range(0, len(rows), PIECE)):
            x = latent[parts[a : a + PIECE]].sum(axis=1)
            x /= np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)
            own = at[ends[n] : ends[n + 1]]
            theirs, common_terms = items[ends[n] : ends[n + 1]], shared[ends[n] : ends[n + 1]]
            like = np.einsum("ij,ij->i", x[own - a], self.rows[theirs])
            for q in np.flatnonzero((like >= s.cosine) & (common_terms >= self.least[theirs]) | (common_terms >= self.enough[theirs])):
                p, c = int(rows[own[q]]), int(theirs[q])
                k, item = int(doc_of[p]), self.item_of[c]
                seen = best.get((k, item))
                if seen is not None and seen[1] == len(self.items[item][1]):
                    continue
                common = self._check(words[k], int(p - offset[k]) * s.segment, item)
                if common is not None and (seen is None or common > seen[1]):
                    best[k, item] = (float(like[q]), common, len(self.items[item][1]))
        return [(k, item, *v) for (k, item), v in sorted(best.items())]

    def _sharing(self, ids: np.ndarray, where: np.ndarray, doc_of: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(passages, items' passages) of the pairs that share enough terms to be compared, sorted."""
        passages, items, shared = self._shared(ids, where, doc_of)
        ok = shared >= self.least[items]
        return passages[ok], items[ok]

    def _shared(self, ids: np.ndarray, where: np.ndarray, doc_of: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(passages, items' passages, occurrences of terms in common) of the pairs that may be candidates, sorted.
        ids, where: terms and their segments."""
        n = len(self.rows)
        count = self.first[ids + 1] - self.first[ids]
        start = np.repeat(self.first[ids] - np.concatenate([[0], np.cumsum(count)[:-1]]), count)
        held = self.held[start + np.arange(len(start))]
        segment = np.repeat(where, count)
        keys = []
        for k in range(self.s.span):  # a segment belongs to the passages that start at it and before it
            first = segment - k
            ok = (first >= 0) & (doc_of[np.maximum(first, 0)] == doc_of[segment])
            keys.append(first[ok] * n + held[ok])
        key = np.sort(np.concatenate(keys))
        edge = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, np.int64)
        times = np.diff(np.concatenate([edge, [len(key)]]))
        key = key[edge]
        passages, items = key // n, key % n
        ok = times >= np.minimum(self.least, self.enough)[items]
        return passages[ok], items[ok], times[ok]

    def _check(self, words: list[str], start: int, item: int) -> int | None:
        s, (_, own, keys, answer) = self.s, self.items[item]
        room = max(8, len(own) // 3)
        around = words[max(0, start - room - max(0, len(own) - s.segment * s.span)) : start + s.segment * s.span + room + max(0, len(own) - s.segment * s.span)]
        if len(own) < s.min_words:
            return len(own) if any(around[i : i + len(own)] == own for i in range(len(around))) else None
        common, first, last = lcs(own, around)
        if common >= s.exact * len(own):
            return common
        if common < s.similar * len(own):
            return None
        near = set(around[max(0, first - 2) : last + 3])
        if answer is not None:
            return common if set(words_of(answer)) <= near else None
        return common if len(near.intersection(keys)) >= s.key_share * len(keys) else None


def _slices(benchmark: DataFrame, s: Settings) -> list[DataFrame]:
    """The benchmark in as many parts, by a hash of the item, as keep each within max_items and max_words."""
    n, words = benchmark.where("text is not null").agg(F.count(F.lit(1)), F.coalesce(F.sum(F.size(F.split("text", r"\W+"))), F.lit(0))).first()
    parts = max(1, -(-n // s.max_items), -(-words // s.max_words))
    return [benchmark.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(parts)) == k) for k in range(parts)] if parts > 1 else [benchmark]


def _item_rows(benchmark: DataFrame) -> list[tuple[int, list[str], str | None]]:
    columns = {c.lower() for c in benchmark.columns}
    answer = F.col("answer").cast("string") if "answer" in columns else F.lit(None).cast("string")
    rows = benchmark.where("text is not null").select(F.col("item_id").cast("bigint"), "text", answer.alias("answer")).collect()  # a slice
    return sorted(((r["item_id"], w, r["answer"]) for r in rows if (w := words_of(r["text"]))), key=lambda x: (x[0] is None, x[0] or 0, x[1], x[2] or ""))


def build(docs: DataFrame, benchmark: DataFrame, text: str = "text", settings: Settings | None = None) -> Index:
    """Document frequencies over all of `docs`, and the latent space of one slice of the benchmark."""
    s = settings or Settings()
    spark = docs.sparkSession
    items = _item_rows(benchmark)
    vocabulary = {w: i for i, w in enumerate(sorted({w for _, own, _ in items for w in own}))}
    if not items:
        return Index(s, {}, np.zeros(0), np.zeros((0, 1)), [])
    known = spark.sparkContext.broadcast(vocabulary)

    def frequencies(batches):
        n, count = 0, np.zeros(len(known.value), np.int64)
        both = frozenset(known.value)
        for batch in batches:
            column = batch.column(text)
            for start, end in text_slices(column):
                for t in column.slice(start, end - start).to_pylist():
                    n += 1
                    for w in both.intersection(words_of(t)):
                        count[known.value[w]] += 1
        some = np.flatnonzero(count)
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([[-1], some]), pa.int64()), pa.array(np.concatenate([[n], count[some]]), pa.int64())], names=["id", "n"])

    df = {r["id"]: r["n"] for r in docs.select(text).mapInArrow(frequencies, "id bigint, n bigint").groupBy("id").agg(F.sum("n").alias("n")).collect()}
    total = df.pop(-1, 0)
    counts = np.zeros(len(vocabulary))
    for i, n in df.items():
        counts[i] = n
    terms = {w for w, i in vocabulary.items() if counts[i] <= s.max_df * total}
    for _, own, _ in items:
        terms.update(sorted(set(own), key=lambda w: (counts[vocabulary[w]], w))[: s.rarest])
    every = np.log((total + 1) / (counts + 1)) + 1
    weight = {w: every[i] for w, i in vocabulary.items()}
    vocabulary = {w: k for k, w in enumerate(sorted(terms))}
    idf = np.array([weight[w] for w in vocabulary])
    vectors = _svd(docs, text, items, vocabulary, idf, s, total).astype(np.float32)
    give_back()
    # The rarest words of an item: very rare ones count alike, as a word that a paraphrase has replaced is rarer by that.
    rare, in_items = max(5, total / 1000), Counter(w for _, own, _ in items for w in set(own))
    frequency = {w: max(rare, (total + 1) / np.exp(x - 1) - 1) for w, x in weight.items()}
    keyed = []
    for item_id, own, answer in items:
        order = sorted(set(own), key=lambda w: (frequency[w], in_items[w], w))
        keyed.append((item_id, own, order[: max(2, len(order) // 4)], answer))
    return Index(s, vocabulary, idf, vectors, keyed)


def _svd(docs: DataFrame, text: str, items, vocabulary: dict[str, int], idf: np.ndarray, s: Settings, total: int) -> np.ndarray:
    """Right singular vectors (words x rank) of the unit TF-IDF passages, by a randomised range finder.

    Tasks hold the passages; each round they return their part of A'(A Q), which is summed by blocks of words before it
    comes to the driver, where Q (words x dimensions) is made orthogonal.
    """
    spark = docs.sparkSession
    size = s.segment * s.span
    share = min(1.0, 2.0 * s.fit_rows / max(1, total))
    some = docs.where(F.col(text).isNotNull() & (F.length(text) <= 65536) & (F.pmod(F.xxhash64(text), F.lit(1 << 20)) < share * (1 << 20)))
    some = some.select(F.col(text).alias("text")).limit(s.fit_rows)
    own = spark.createDataFrame([(" ".join(w), 4.0) for _, w, _ in items], "text string, weight double")  # items count more
    sample = written(some.withColumn("weight", F.lit(1.0)).unionByName(own).repartition(8), "fit-passages")
    rank = min(s.rank, len(vocabulary))
    known = spark.sparkContext.broadcast((vocabulary, idf))
    block = 1024

    def passages(batch):
        words, idfs = known.value
        for t, weight in zip(batch.column("text").to_pylist(), batch.column("weight").to_pylist()):
            ids = [words.get(w, -1) for w in words_of(t)]
            for start in range(0, max(1, len(ids) - size // 2), size):
                x, n = np.unique([i for i in ids[start : start + size] if i >= 0], return_counts=True)
                if len(x):
                    x = x.astype(np.int64)
                    v = n * idfs[x]
                    yield x, weight * v / np.linalg.norm(v)

    q = np.linalg.qr(np.random.default_rng(s.seed).standard_normal((len(vocabulary), rank)))[0]
    for _ in range(3):
        shared = spark.sparkContext.broadcast(q)

        def multiply(batches):
            y = np.zeros_like(shared.value)
            for batch in batches:
                for x, v in passages(batch):
                    y[x] += v[:, None] * (v @ shared.value[x])
            starts = range(0, len(y), block)
            yield pa.RecordBatch.from_arrays([pa.array(list(starts), pa.int64()), pa.array([y[a : a + block].tobytes() for a in starts], pa.binary())], names=["at", "y"])

        def add(t: pa.Table) -> pa.Table:
            return pa.table({"at": t.column("at")[:1], "y": pa.array([sum(np.frombuffer(b) for b in t.column("y").to_pylist()).tobytes()], pa.binary())})

        y = np.zeros_like(q)
        for r in sample.mapInArrow(multiply, "at bigint, y binary").groupBy("at").applyInArrow(add, "at bigint, y binary").collect():
            part = np.frombuffer(r["y"]).reshape(-1, rank)
            y[r["at"] : r["at"] + len(part)] = part
        shared.unpersist()
        last, q = q, np.linalg.qr(y)[0]
    # Rayleigh-Ritz on the last product: the eigenvectors of Q'A'AQ turn Q into singular vectors
    values, turn = np.linalg.eigh((last.T @ y + y.T @ last) / 2)
    vectors = last @ turn[:, ::-1]
    return vectors[:, values[::-1] > 1e-9 * max(values.max(), 1e-30)]


def matches(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text", settings: Settings | None = None) -> DataFrame:
    """A row for each document and item found in it: key, item_id, cosine, common_words, item_words, share.

    Documents without an item have no row. Null and empty texts and items have none; items that repeat are found each;
    rows that repeat a key are searched each. No shuffle of documents."""
    base = docs.select(F.col(key).alias("__key"), F.col(text).alias("__text"))
    schema = T.StructType([T.StructField(key, base.schema["__key"].dataType), *T._parse_datatype_string("item_id bigint, cosine double, common_words bigint, item_words bigint, share double").fields])

    def found(part: DataFrame) -> DataFrame:
        shared = docs.sparkSession.sparkContext.broadcast(build(docs, part, text, settings))  # a slice's index

        def each(batches):
            index = shared.value
            for batch in batches:
                for start, end in text_slices(batch.column("__text")):
                    rows = batch.slice(start, end - start)
                    hits = index.search(rows.column("__text").to_pylist())
                    if hits:
                        at, item, cosine, common, size = (np.array(x) for x in zip(*hits))
                        yield pa.RecordBatch.from_arrays([rows.column("__key").take(pa.array(at)), pa.array([index.items[i][0] for i in item], pa.int64()), pa.array(cosine, pa.float64()), pa.array(common, pa.int64()), pa.array(size, pa.int64()), pa.array(common / size, pa.float64())], names=[key, "item_id", "cosine", "common_words", "item_words", "share"])

        return base.mapInArrow(each, schema)

    return reduce(DataFrame.unionByName, map(found, _slices(benchmark, settings or Settings())))


def mark(docs: DataFrame, benchmark: DataFrame, text: str = "text", settings: Settings | None = None) -> DataFrame:
    """`docs` with n_items, the number of benchmark items found in each row's text. A column of this name is replaced."""
    out = docs.select(*[docs[c] for c in without(docs, "n_items")], F.lit(0).cast("bigint").alias("n_items"))

    def added(rows: DataFrame, part: DataFrame) -> DataFrame:
        shared = docs.sparkSession.sparkContext.broadcast(build(docs, part, text, settings))  # a slice's index

        def each(batches):
            for batch in batches:
                n = np.array(batch.column("n_items"), np.int64)
                column = batch.column(batch.schema.names.index(text))
                for start, end in text_slices(column):
                    for row, *_ in shared.value.search(column.slice(start, end - start).to_pylist()):
                        n[start + row] += 1
                yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(n)], names=batch.schema.names)
            give_back()

        return rows.mapInArrow(each, rows.schema)

    return reduce(added, _slices(benchmark, settings or Settings()), out)
