"""N-gram Jaccard self-join with set-relation skipping: which texts share 5-word shingles at a similarity of 0.8.

A text's set is that of its distinct 5-word shingles, each as a 64-bit hash. Texts with equal sets are one set from
the start. Two sets can only reach the similarity if they share a token among the first (a fifth) of either in one
global order, and then the first shared token lies far enough ahead; so

1. tokens that many texts hold are estimated on a sample and put last in the order (which order is taken cannot
   change the result, only the work);
2. each set's first tokens go into index lists, with the set's size and the token's position. Lists of one set go. A
   list is cut into blocks by size; blocks whose sizes differ too much are skipped, and partners whose positions leave
   too few tokens behind them are skipped too;
3. in each block one set leads (that with the most frequent tokens, the same in most lists of a group of near copies),
   and only it is compared with the others of its block: as many pairs as entries, whatever a list's length. Sets that
   link with a leader take its class, lists that lie within one class are skipped, and the others of frequent tokens
   get new leaders, LEADERS times or until no new link is found;
4. what a leader's comparison has told is carried over to the sets highly similar to it. If x has all but d(x) of its
   tokens in common with its leader a, and y all but d(y) with b, x and y share no more than |a & b| + d(x) + d(y). So
   the lists are joined class by class, heads are compared with heads, and single members only where that bound,
   counted on their first tokens too, leaves the similarity possible. A bitmap of each set (the parity of its tokens
   by hash) gives another bound, on the tokens that only one of two sets has;
5. classes of verified links are found by star contraction, over tables in the shared folder.

No list is cut, no partner dropped. A link inside a class may stay unverified, as it can't change a class.
"""

from __future__ import annotations

import hashlib
import math
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._io import discard, give_back, small_batches, text_slices, without, written

WORDS, PERCENT = 5, 80
HOT_TOKENS, HOT_SAMPLE = 1_000_000, 16
LEADERS = 3  # times that long lists get leaders before their classes are joined; shapes the work, not the result
BITMAP = 16  # 64-bit words of a set's bitmap
BROADCAST = 500_000  # names of sets, each of 8 bytes
STREAM = 256  # partners of a leader that one group of rows brings to it
POSTING = np.dtype([("t", "<u8"), ("s", "<i8"), ("n", "<u4"), ("p", "<u4"), ("w", "<u4")])

_WHITE = np.zeros(256, bool)
_WHITE[[32, 9, 10, 11, 12, 13]] = True
_K = np.uint64(0x9E3779B97F4A7C15)
_BYTE = (np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93)) ^ (np.arange(1, 257, dtype=np.uint64) * _K >> np.uint64(31))
_LONG = 64  # bytes; a longer word's hash is a digest
_POWER = np.cumprod(np.full(_LONG, np.uint64(0xA0761D6478BD642F)), dtype=np.uint64)
_GAP = re.compile(rb"[\x20\x09-\x0D]")
_BLOCK = 1 << 20


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _words(buffer: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Start and hash of every word of a buffer that ends in white space."""
    raw = np.frombuffer(buffer, np.uint8)
    white = _WHITE[raw]
    before = np.empty_like(white)
    before[0], before[1:] = True, white[:-1]
    first = before & ~white
    starts = np.flatnonzero(first)
    if not len(starts):
        return starts, np.zeros(0, np.uint64)
    at = np.arange(len(raw))
    inside = at - np.maximum.accumulate(np.where(first, at, 0))
    value = _BYTE[raw] * _POWER[inside & (_LONG - 1)] + inside.astype(np.uint64)
    value[white] = 0
    hashes = _mix(np.add.reduceat(value, starts))
    ends = np.flatnonzero(white & ~before)
    for k in np.flatnonzero(ends - starts > _LONG):
        hashes[k] = _digest(buffer[starts[k] : ends[k]])
    return starts, hashes


def _digest(word: bytes) -> int:
    return int.from_bytes(hashlib.blake2b(word, digest_size=8).digest(), "little")


def shingle_sets(texts: list[str | None], words: int = WORDS) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each text; A-Z count as a-z; null and blank texts have none."""
    out: list[np.ndarray] = []
    k = 0
    while k < len(texts):
        parts, held = [], 0
        while k + len(parts) < len(texts) and (not parts or held < _BLOCK):
            part = (texts[k + len(parts)] or "").encode("utf-8", "surrogatepass").lower()
            if parts and len(part) > _BLOCK:
                break  # a long text goes alone, block by block
            parts.append(part)
            held += len(part) + 1
        if len(parts) == 1 and held > _BLOCK:
            out.append(_set(_long(parts[0]), words))
        else:
            starts, hashes = _words(b" ".join(parts) + b" ")
            cuts = np.searchsorted(starts, np.cumsum([len(p) + 1 for p in parts]))
            out += [_set(hashes[a:b], words) for a, b in zip(np.concatenate([[0], cuts[:-1]]), cuts)]
        k += len(parts)
    return out


def _long(raw: bytes) -> np.ndarray:
    """Word hashes of one very long text, block by block, cut at white space; a word longer than a block is a digest."""
    out, start = [], 0
    while start < len(raw):
        end = start + _BLOCK
        if end < len(raw):
            end = max(raw.rfind(c, start, end) for c in (b" ", b"\t", b"\n", b"\v", b"\f", b"\r"))
        if end < start:
            gap = _GAP.search(raw, start + _BLOCK)
            end = gap.start() if gap else len(raw)
            out.append(np.array([_digest(raw[start:end])], np.uint64))
        else:
            out.append(_words(raw[start:end] + b" ")[1])
        start = end + 1
    return np.concatenate(out)


def _set(w: np.ndarray, words: int) -> np.ndarray:
    if not len(w):
        return w
    span = min(words, len(w))
    h = np.zeros(len(w) - span + 1, np.uint64)
    for i in range(span):
        h = _mix(h * _K + w[i : len(w) - span + 1 + i])
    h.sort()
    return h[np.concatenate([[True], h[1:] != h[:-1]])]


def signature(h: np.ndarray) -> int:
    """One number for a set (64 bits)."""
    return int(_mix(np.array([_mix(h ^ _K).sum(dtype=np.uint64) + np.uint64(len(h))])).view(np.int64)[0])


def least_overlap(n, m, percent: int = PERCENT):
    """Shared tokens that sets of n and m tokens need."""
    return -(-percent * (n + m) // (100 + percent))


def bitmap(h: np.ndarray) -> np.ndarray:
    """The parity of a set's tokens by hash, as BITMAP numbers: two bitmaps differ in no more bits than their sets in tokens."""
    odd = np.bincount((h >> np.uint64(40)).astype(np.int64) % (64 * BITMAP), minlength=64 * BITMAP).astype(np.uint8) & 1
    return np.packbits(odd, bitorder="little").view("<i8")


def prefix(h: np.ndarray, hot: np.ndarray, rank: np.ndarray, percent: int = PERCENT) -> tuple[np.ndarray, int]:
    """The first tokens of a set in the global order, and how many of them are hot: others by hash, then hot ones from
    the rarest."""
    n, cold = len(h), len(h)
    if len(hot):
        at = np.minimum(np.searchsorted(hot, h), len(hot) - 1)
        is_hot = hot[at] == h
        if is_hot.any():
            own = h[is_hot]
            cold -= len(own)
            h = np.concatenate([h[~is_hot], own[np.lexsort((own, rank[at[is_hot]]))]])
    size = n - (percent * n + 99) // 100 + 1
    return h[:size], max(0, size - cold)


def _texts(batches, text: str):
    for batch in batches:
        column = batch.column(batch.schema.names.index(text))
        for start, end in text_slices(column):
            yield batch.slice(start, end - start), shingle_sets(column.slice(start, end - start).to_pylist())
    give_back()


def _blobs(arrays: list[np.ndarray], key: np.ndarray, parts: int) -> pa.RecordBatch:
    """Rows (part, blob) of records dealt out by their token."""
    all_ = np.concatenate(arrays)
    part = (key >> np.uint64(33)).astype(np.int64) % parts
    order = np.argsort(part, kind="stable")
    cuts = np.searchsorted(part[order], np.arange(parts + 1))
    all_ = all_[order]
    some = [k for k in range(parts) if cuts[k + 1] > cuts[k]]
    return pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array([all_[cuts[k] : cuts[k + 1]].tobytes() for k in some], pa.binary())], names=["part", "blob"])


def _joined(t: pa.Table, dtype) -> np.ndarray:
    return np.concatenate([np.frombuffer(b, dtype) for b in t.column("blob").to_pylist()])


def _parts(docs: DataFrame) -> int:
    """Number of token parts, so that one holds some 16 MB; from the size that the planner knows."""
    size = int(str(docs._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return max(64, min(1 << 20, size // (16 << 20) if size < 1 << 60 else 64))


def _hot(docs: DataFrame, text: str, parts: int) -> tuple[np.ndarray, np.ndarray]:
    """(sorted tokens, their counts): tokens that three or more sets of the sample hold, the HOT_TOKENS most frequent.
    The sample, one text in HOT_SAMPLE by its hash, only shapes the global order."""

    def tokens(batches):
        seen, held, size = set(), [], 0
        for _, sets in _texts(batches, text):
            for h in sets:
                if len(h) and (s := signature(h)) not in seen:
                    seen.add(s)
                    held.append(h)
                    size += len(h)
            if size > 1 << 18:
                yield _blobs(held, np.concatenate(held), parts)
                held, size = [], 0
        if held:
            yield _blobs(held, np.concatenate(held), parts)

    def count(t: pa.Table) -> pa.Table:
        value, n = np.unique(_joined(t, "<u8"), return_counts=True)
        top = np.flatnonzero(n >= 3)
        return pa.table({"t": pa.array(value[top].view(np.int64), pa.int64()), "n": pa.array(n[top], pa.int64())})

    some = docs.where(F.pmod(F.xxhash64(text), F.lit(HOT_SAMPLE)) == 0).select(text)
    counts = some.mapInArrow(tokens, "part int, blob binary").groupBy("part").applyInArrow(count, "t bigint, n bigint")
    rows = counts.orderBy(F.desc("n"), "t").limit(HOT_TOKENS).toArrow()
    t = rows.column("t").to_numpy().astype(np.int64).view(np.uint64)
    order = np.argsort(t)
    return t[order], rows.column("n").to_numpy()[order]


def _live(p: np.ndarray, hot: np.ndarray, percent: int) -> pa.Table:
    """The postings of tokens that two sets hold at least, each with the leader of its block that it can reach (a, na).
    Those of hot tokens are spread over all parts: all stay, and have no leader yet."""
    band = np.floor(np.log(np.maximum(p["n"], 1)) / math.log(101 / percent)).astype(np.int64)
    order = np.lexsort((p["s"], p["w"], band, p["t"]))
    p, band = p[order], band[order]
    p = p[new := np.concatenate([[True], (p["t"][1:] != p["t"][:-1]) | (p["s"][1:] != p["s"][:-1])])]
    band = band[new]
    edge = np.concatenate([[True], p["t"][1:] != p["t"][:-1]])
    size = np.diff(np.concatenate([np.flatnonzero(edge), [len(p)]]))
    block = edge | np.concatenate([[True], band[1:] != band[:-1]])
    sizes = np.diff(np.concatenate([np.flatnonzero(block), [len(p)]]))
    lead = p[np.repeat(np.cumsum(sizes) - 1, sizes)]
    is_hot = _among(p["t"], hot)
    n, m = p["n"].astype(np.int64), lead["n"].astype(np.int64)
    led = ~is_hot & (p["s"] != lead["s"]) & (100 * np.minimum(n, m) >= percent * np.maximum(n, m))
    led &= np.minimum(n - p["p"], m - lead["p"]) >= least_overlap(n, m, percent)
    stay = np.repeat(size > 1, size) | is_hot
    column = lambda x, mask=None: pa.array(x.astype(np.int64)[stay], pa.int64(), mask=None if mask is None else mask[stay])
    out = {"t": pa.array(p["t"].astype(np.uint64).view(np.int64)[stay]), **{c: column(p[c]) for c in ("s", "n", "p", "w")}}
    return pa.table(out | {"hot": pa.array(is_hot[stay]), "a": column(lead["s"], ~led), "na": column(m, ~led)})


def _among(t: np.ndarray, hot: np.ndarray) -> np.ndarray:
    return hot[np.minimum(np.searchsorted(hot, t), len(hot) - 1)] == t if len(hot) else np.zeros(len(t), bool)


def _needed(n: Column, m: Column, percent: int) -> Column:
    """least_overlap() of two columns."""
    return F.ceil(percent * (n + m) / F.lit(100.0 + percent) - 1e-9)


def _behind(n: Column, percent: int) -> Column:
    """Tokens behind the first ones of a set."""
    return F.floor((percent * n + 99) / 100) - 1


def _near(n: Column, m: Column, percent: int) -> Column:
    return (100 * n >= percent * m) & (100 * m >= percent * n)


def _by_leaders(lists: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b, na, nb) of the leader a of each list's block with the sets of other classes that it can reach.
    lists: (t, s, n, p, w, root), and `led` for sets that have led before."""
    sized = lists.withColumn("band", F.floor(F.log(F.col("n").cast("double")) / math.log(101 / percent)).cast("int"))
    first = F.max(F.when(~F.col("led"), F.struct("w", F.xxhash64("s").alias("h"), "s", "n", "p", "root"))).alias("l")
    lead = sized.groupBy("t", "band").agg(first, F.min("root").alias("x"), F.max("root").alias("y")).where("x <> y and l is not null").select("t", "band", "l")
    met = sized.join(lead, ["t", "band"]).where("root <> l.root")
    ahead = F.least(F.col("n") - F.col("p"), F.col("l.n") - F.col("l.p"))
    met = met.where(_near(F.col("n"), F.col("l.n"), percent) & (ahead >= _needed(F.col("n"), F.col("l.n"), percent)))
    return met.select(F.col("l.s").alias("a"), F.col("s").alias("b"), F.col("l.n").alias("na"), F.col("n").alias("nb")).distinct()


def _bits(side: str = "") -> list[Column]:
    return [F.col(f"b{i}").alias(f"b{i}{side}") for i in range(BITMAP)]


def _alike(percent: int) -> Column:
    """Whether the bitmaps b0a... and b0b... of sets of na and nb tokens leave the similarity possible."""
    apart = sum((F.bit_count(F.col(f"b{i}a").bitwiseXOR(F.col(f"b{i}b"))) for i in range(1, BITMAP)), F.bit_count(F.col("b0a").bitwiseXOR(F.col("b0b"))))
    return apart <= F.col("na") + F.col("nb") - 2 * _needed(F.col("na"), F.col("nb"), percent)


def _possible(pairs: DataFrame, firsts: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b, na, nb) that bitmaps and the count of shared first tokens leave possible: two sets share no more
    than those and what lies behind the first tokens of the one whose first tokens end earlier."""
    side = lambda c: firsts.select(F.col("s").alias(c), F.col("ts").alias(f"t{c}"), *_bits(c))
    most = F.size(F.array_intersect("ta", "tb")) + F.greatest(_behind(F.col("na"), percent), _behind(F.col("nb"), percent))
    both = pairs.join(side("b"), "b").join(side("a"), "a").where(_alike(percent)).where(most >= _needed(F.col("na"), F.col("nb"), percent))
    return both.select("a", "b", "na", "nb")


def verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (a, b, na, nb) with `both`, the number of tokens that their whole sets share. sets: (s, blob).

    The sets that a leader `a` is compared with are brought to it in groups of some STREAM rows, the leader's own row
    first, and stream past it: no task holds more than one leader's set and one batch."""
    counts = pairs.groupBy("a").agg(F.ceil(F.count(F.lit(1)) / F.lit(STREAM)).cast("int").alias("groups"))
    group = F.pmod(F.xxhash64("b"), F.col("groups")).cast("int").alias("g")
    members = pairs.join(counts, "a").select("a", "b", "na", "nb", group).join(sets.withColumnRenamed("s", "b"), "b")
    none = F.lit(None).cast("bigint")
    leaders = counts.join(sets.withColumnRenamed("s", "a"), "a").select("a", none.alias("b"), none.alias("na"), none.alias("nb"), F.explode(F.sequence(F.lit(0), F.col("groups") - 1)).alias("g"), "blob")

    def stream(batches):
        name, x = None, None
        for batch in batches:
            out = []
            for a, g, b, blob in zip(*(batch.column(c) for c in ("a", "g", "b", "blob"))):
                y = np.frombuffer(blob.as_buffer(), "<u8")
                if not b.is_valid:
                    name, x = (a.as_py(), g.as_py()), y.copy()
                    out.append(None)
                    continue
                if name != (a.as_py(), g.as_py()):
                    raise RuntimeError("a leader's set is missing")
                few, many = (x, y) if len(x) < len(y) else (y, x)
                out.append(int((many[np.minimum(np.searchsorted(many, few), len(many) - 1)] == few).sum()))
            found = pa.array(out, pa.int64())
            yield batch.select(["a", "b", "na", "nb"]).append_column("both", found).filter(found.is_valid())
        give_back()

    rows = leaders.select("a", "g", "b", "na", "nb", "blob").unionByName(members.select("a", "g", "b", "na", "nb", "blob"))
    return rows.repartition("a", "g").sortWithinPartitions(F.col("a"), F.col("g"), F.col("b").asc_nulls_first()).mapInArrow(stream, "a bigint, b bigint, na bigint, nb bigint, both bigint")


def _joined_classes(lists: DataFrame, own: DataFrame, percent: int, keep=written) -> DataFrame:
    """(a, b): heads of two classes with members that can be similar by size, position and the number of lists in which
    both stand. lists: (t, s, n, p); own: (s, n, root, c, d), the class c that each set stands for and its root."""
    entries = lists.join(own.select("s", "root", "c"), "s").groupBy("t", "c").agg(F.max("root").alias("root"), F.min("n").alias("low"), F.max("n").alias("high"), F.max(F.col("n") - F.col("p")).alias("ahead"))
    mixed = entries.groupBy("t").agg(F.min("root").alias("x"), F.max("root").alias("y")).where("x <> y").select("t")
    entries = keep(entries.join(mixed, "t"), "entries")
    side = lambda c: entries.select("t", *[F.col(x).alias(f"{x}_{c}") for x in ("c", "root", "low", "high", "ahead")])
    reach = (100 * F.col("high_a") >= percent * F.col("low_b")) & (100 * F.col("high_b") >= percent * F.col("low_a"))
    both = side("a").join(side("b"), "t").where((F.col("c_a") < F.col("c_b")) & (F.col("root_a") != F.col("root_b")) & reach)
    ahead = F.least("ahead_a", "ahead_b") >= _needed(F.col("low_a"), F.col("low_b"), percent)
    met = both.groupBy(F.col("c_a").alias("a"), F.col("c_b").alias("b")).agg(F.count(F.lit(1)).alias("met"), F.max(ahead).alias("ahead"), F.min(F.col("low_a") + F.col("low_b")).alias("low"), F.max(F.greatest("high_a", "high_b")).alias("high"))
    return met.where(F.col("ahead") & (F.col("met") + _behind(F.col("high"), percent) >= _needed(F.col("low"), F.lit(0), percent))).select("a", "b")


def _are_links(percent: int) -> Column:
    return 100 * F.col("both") >= percent * (F.col("na") + F.col("nb") - F.col("both"))


def classes(links: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(node, root) for every node of the links (a, b): root is the smallest node of its class. Alternates large and
    small stars; each round's edges are a written table. Ends when the edges are stars: no node has two edges upward,
    and none that has one is an end of another."""
    spark = links.sparkSession
    edges = written(links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges")
    for _ in range(most_rounds):
        ends = edges.select(F.col("u").alias("x"), F.lit(1).alias("up"), F.lit(0).alias("down")).unionByName(edges.select(F.col("v").alias("x"), F.lit(0).alias("up"), F.lit(1).alias("down")))
        if ends.groupBy("x").agg(F.sum("up").alias("up"), F.max("down").alias("down")).where("up > 1 or up = 1 and down = 1").isEmpty():
            return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").unionByName(low.select("u", F.col("m").alias("v"))).distinct()
        after = written(small.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")), "edges")
        discard(spark, edges)
        edges = after
    raise RuntimeError("the classes did not settle")


def components(df: DataFrame, key: str = "doc_id", text: str = "text", percent: int = PERCENT) -> DataFrame:
    """`df` without its text column, one row for each of its rows, with n_shingles (size of the set) and component_id.

    component_id is the smallest key reachable by links, the row's own included. Texts with fewer than five words
    have their whole sequence as one shingle; null texts and those without words have none and are linked with
    nothing. Keys are bigint; rows that repeat a key are rows of their own. A row without a key is linked like any other,
    and a class in which no row has a key has a null component_id. Columns of these names are replaced. An empty table gives an empty result.
    """
    if not 50 < percent <= 100:
        raise ValueError("percent must be over 50, and 100 at most")
    with small_batches(df.sparkSession, 1000):
        return _components(df, key, text, percent)


def _components(df: DataFrame, key: str, text: str, percent: int) -> DataFrame:
    spark = df.sparkSession
    docs = df.select(F.col(key).cast("bigint").alias("k"), F.col(text).alias("text"))
    rest = without(df, key, text, "n_shingles", "component_id")
    parts = _parts(docs)
    hot, rank = _hot(docs, "text", parts)
    order = spark.sparkContext.broadcast((hot, rank))  # HOT_TOKENS entries at most, 16 MB
    give_back()

    # One pass over the texts gives two kinds of rows: the table's own, with the size and name of their sets (and the
    # bitmap; the other columns go along, so that no join by key is needed to bring them back), and postings in blobs.
    whole = df.select(F.col(key).cast("bigint").alias("k"), F.col(text).alias("text"), *[F.col(c).alias(f"r{i}") for i, c in enumerate(rest)])
    number = T.LongType()
    numbers = [*("k", "s", "n"), *(f"b{i}" for i in range(BITMAP))]
    schema = T.StructType([*(T.StructField(c, number) for c in numbers), *(T.StructField(f.name, f.dataType) for f in whole.schema.fields[2:]), T.StructField("part", T.IntegerType()), T.StructField("blob", T.BinaryType())])

    def indexed(batches):
        seen, held, size = set(), [], 0
        kinds: list = []

        def posted():
            found = _blobs(held, spread(held), parts)
            empty = [pa.nulls(len(found), pa.int64()) for _ in numbers] + [pa.nulls(len(found), kind) for kind in kinds]
            return pa.RecordBatch.from_arrays([*empty, *found.columns], names=schema.names)

        for batch, sets in _texts(batches, "text"):
            kinds = [f.type for f in batch.schema][2:]
            names = [signature(h) if len(h) else None for h in sets]
            bits = np.stack([bitmap(h) for h in sets], 1) if sets else np.zeros((BITMAP, 0), "<i8")
            columns = [batch.column("k"), pa.array(names, pa.int64()), pa.array([len(h) for h in sets], pa.int64()), *(pa.array(b) for b in bits), *batch.columns[2:]]
            yield pa.RecordBatch.from_arrays([*columns, pa.nulls(len(sets), pa.int32()), pa.nulls(len(sets), pa.binary())], names=schema.names)
            for s, h in zip(names, sets):
                if s is None or s in seen:
                    continue
                seen.add(s)
                first, warm = prefix(h, *order.value, percent)
                rows = np.empty(len(first), POSTING)
                rows["t"], rows["s"], rows["n"], rows["p"], rows["w"] = first, s, len(h), np.arange(len(first)), warm
                held.append(rows)
                size += len(rows)
            if size > 1 << 17:
                yield posted()
                held, size = [], 0
        if held:
            yield posted()

    def spread(held: list[np.ndarray]) -> np.ndarray:
        # a hot token's list lies in all parts: that two sets hold it is known
        all_ = np.concatenate(held)
        return np.where(_among(all_["t"], order.value[0]), _mix(all_["s"].view(np.uint64)), all_["t"])

    def live_of(t: pa.Table) -> pa.Table:
        out = _live(_joined(t, POSTING), order.value[0], percent)
        give_back()
        return out

    index = written(whole.mapInArrow(indexed, schema), "index")
    members, postings = written(index.where("part is null").drop("part", "blob"), "members"), index.where("part is not null").select("part", "blob")
    owners = members.where("s is not null").groupBy("s").agg(F.min("k").alias("owner"), F.first("n").alias("n"), *[F.first(f"b{i}").alias(f"b{i}") for i in range(BITMAP)])

    def blobs(batches):
        for _, sets in _texts(batches, "text"):
            done, rows = set(), []
            for h in sets:
                if len(h) and (s := signature(h)) not in done:
                    done.add(s)
                    rows.append((s, h.astype("<u8").tobytes()))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.binary())], names=["s", "blob"])

    held: list[DataFrame] = []

    def keep(rows: DataFrame, what: str) -> DataFrame:
        held.append(written(rows, what))
        return held[-1]

    def compared(pairs: DataFrame) -> DataFrame:
        """`pairs` with the sizes of their intersections, as a written table; sets are made anew from one text of each."""
        ids = written(pairs.select(F.col("a").alias("s")).unionByName(pairs.select(F.col("b").alias("s"))).distinct(), "ids")
        few = ids.count() <= BROADCAST
        some = F.broadcast if few else (lambda rows: rows)  # BROADCAST names at most; more are met by a shuffled join
        wanted = some(members.join(some(ids), "s").groupBy("s").agg(F.min("k").alias("owner")).select("owner"))
        rows = docs.join(wanted, F.col("k").eqNullSafe(F.col("owner")), "left_semi").select("text").mapInArrow(blobs, "s bigint, blob binary")
        sets = written(rows.join(some(ids), "s", "left_semi").dropDuplicates(["s"]), "sets")
        with small_batches(spark, 250):
            out = keep(verified(pairs, sets), "compared")
        discard(spark, ids, sets)
        return out

    lists = keep(postings.groupBy("part").applyInArrow(live_of, "t bigint, s bigint, n bigint, p bigint, w bigint, hot boolean, a bigint, na bigint"), "lists")
    discard(spark, index)
    firsts = keep(lists.groupBy("s").agg(F.collect_list("t").alias("ts")).join(owners.drop("owner"), "s"), "firsts")

    def labelled(rows: DataFrame, known: DataFrame) -> DataFrame:
        return rows.join(known, F.col("s") == F.col("node"), "left").select(*rows.columns, F.coalesce("root", "s").alias("root"))

    long = lists.where("hot").select("t", "s", "n", "p", "w")
    for turn in range(LEADERS):
        if not turn:
            pairs = _by_leaders(long.select("*", F.col("s").alias("root"), F.lit(False).alias("led")), percent)
            pairs = pairs.unionByName(lists.where("a is not null").select("a", F.col("s").alias("b"), "na", F.col("n").alias("nb"))).distinct()
        else:
            leaders = seen.select(F.col("a").alias("s"), F.lit(True).alias("led")).distinct()
            rows = labelled(long, known).join(leaders, "s", "left").withColumn("led", F.coalesce("led", F.lit(False)))
            tried = seen.select("a", "b").unionByName(seen.select(F.col("b").alias("a"), F.col("a").alias("b")))
            pairs = _by_leaders(rows, percent).join(tried, ["a", "b"], "left_anti")
        pairs = keep(_possible(pairs, firsts, percent), "pairs")
        if turn and pairs.isEmpty():
            break
        found = compared(pairs)
        seen = found if not turn else seen.unionByName(found)
        if turn and found.where(_are_links(percent)).isEmpty():
            break
        known = classes(seen.where(_are_links(percent)).select("a", "b"))

    # each set's head: the leader it shares most with, and how many of its tokens that one lacks
    links = seen.where(_are_links(percent))
    share = F.col("both") / (F.col("na") + F.col("nb") - F.col("both"))
    heads = links.groupBy(F.col("b").alias("s")).agg(F.max(F.struct(share.alias("j"), F.col("a").alias("c"), (F.col("nb") - F.col("both")).alias("d"))).alias("h")).select("s", "h.c", "h.d")
    own = labelled(firsts.drop("ts"), known).join(heads, "s", "left").select("s", "n", "root", *_bits(), F.coalesce("c", "s").alias("c"), F.coalesce("d", F.lit(0)).alias("d"))
    own = keep(own, "heads")
    found = _joined_classes(lists, own, percent, keep)
    pairs = keep(found.join(own.select(F.col("s").alias("a"), F.col("n").alias("na")), "a").join(own.select(F.col("s").alias("b"), F.col("n").alias("nb")), "b"), "pairs")
    linked = links.select("a", "b")
    if not pairs.isEmpty():
        heads = compared(pairs.select("a", "b", "na", "nb"))
        linked = linked.unionByName(heads.where(_are_links(percent)).select("a", "b"))
        wide = own.groupBy("c").agg(F.max("d").alias("d"), F.min("n").alias("low"))
        side = lambda c: wide.select(F.col("c").alias(c), F.col("d").alias(f"d{c}"), F.col("low").alias(f"low{c}"))
        undecided = heads.where(~_are_links(percent)).join(side("a"), "a").join(side("b"), "b").where("da + db > 0")
        undecided = keep(undecided.where(F.col("both") + F.col("da") + F.col("db") >= _needed(F.col("lowa"), F.col("lowb"), percent)).select("a", "b", "both"), "undecided")
        if not undecided.isEmpty():
            known = classes(linked)
            member = labelled(own.drop("root"), known)
            side = lambda c: member.select(F.col("c").alias(c), F.col("s").alias(f"s{c}"), F.col("n").alias(f"n{c}"), F.col("d").alias(f"d{c}"), F.col("root").alias(f"r{c}"), *_bits(c))
            bound = F.col("both") + F.col("da") + F.col("db") >= _needed(F.col("na"), F.col("nb"), percent)
            single = undecided.join(side("a"), "a").join(side("b"), "b").where(bound & (F.col("ra") != F.col("rb")) & _near(F.col("na"), F.col("nb"), percent) & _alike(percent))
            single = single.select(F.col("sa").alias("a"), F.col("sb").alias("b"), "na", "nb").distinct()
            last = compared(keep(_possible(single, firsts, percent), "pairs"))
            linked = linked.unionByName(last.where(_are_links(percent)).select("a", "b"))
    roots = classes(linked)
    named = owners.join(roots.withColumnRenamed("node", "s"), "s", "left").select("s", "owner", F.coalesce("root", "s").alias("root"))
    least = named.groupBy("root").agg(F.min("owner").alias("least"))
    of = named.join(least, "root").select("s", "least")
    discard(spark, *held)
    back = [F.col(f"r{i}").alias(c) for i, c in enumerate(rest)]
    return members.join(of, "s", "left").select(F.col("k").alias(key), *back, F.col("n").alias("n_shingles"), F.coalesce("least", "k").alias("component_id"))



ORACLE = r"""
WITH RECURSIVE w AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM documents),
g AS (SELECT DISTINCT doc_id, array_to_string(list_slice(ws, i, i + 4), ' ') AS sh FROM (SELECT doc_id, ws, unnest(generate_series(1, greatest(len(ws) - 4, 1))) AS i FROM w WHERE len(ws) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM g GROUP BY doc_id),
o AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS o FROM g a JOIN g b ON a.sh = b.sh AND a.doc_id <> b.doc_id GROUP BY ALL),
e AS (SELECT a, b FROM o JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * o >= 80 * (x.n + y.n - o)),
r(doc_id, c) AS (SELECT doc_id, doc_id FROM w UNION SELECT e.b, r.c FROM r JOIN e ON e.a = r.doc_id WHERE r.c < e.b)
SELECT w.doc_id, coalesce(max(n.n), 0)::BIGINT AS n_shingles, min(r.c) AS component_id FROM w JOIN r USING (doc_id) LEFT JOIN n USING (doc_id) GROUP BY w.doc_id"""
