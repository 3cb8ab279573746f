"""SentencePiece encoding and decoding by a max-plus parallel scan.

The model file is a public one; it is never trained here. Its kind is BPE: the encoding of a text is what greedy
merging by piece rank gives. That is a path problem too: a sequence of pieces is the encoding of its text exactly if
every two neighbours are the encoding of the two together (merging inside one piece never looks past its neighbour).
So over the max-plus semiring let a step from piece a to piece b weigh 0 if encode(a + b) is (a, b), else minus
infinity; the encoding is the one path of weight 0.

A text is cut into chunks of `chunk_chars` characters, wherever that falls. A chunk's state at its border is the
piece that holds the last character before the border (piece, and how far it reaches beyond). Each chunk yields the
matrix of best path weights from every state at its left border to every state at its right border; matrices are
multiplied associatively (in blocks, then over blocks), which gives the state at every border, and each chunk is then
traced back by itself between its two states. A text of one chunk has one matrix with one entry.

Where no piece can cross (before a run of word marks that follows other text) there is one state, so the matrices on
both sides are a column and a row, and either side has its path by itself. What lies between two such places is
encoded by the model's C++ library, or with `library=False` stretch by stretch by the same recursion as the fringes of a
chunk (ids are equal; it takes some ten times the time). Characters outside the vocabulary are single symbols that
become byte pieces.
"""

from __future__ import annotations

import re
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._io import give_back, slices, text_slices, without, written

MARK = "▁"  # stands for a blank
CHUNK, BLOCK = 32768, 256  # characters of a chunk; chunks of a block
LOW = -np.inf
_STRETCH = re.compile(f"{MARK}*[^{MARK}]+|{MARK}+")


def default_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


class Coder:
    """One worker's model: pieces, the step test and the library's encoder."""

    def __init__(self, model: bytes, library: bool = True):
        import sentencepiece

        self.library = library
        self.sp = sentencepiece.SentencePieceProcessor(model_proto=model)
        pieces = [self.sp.id_to_piece(i) for i in range(self.sp.get_piece_size())]
        plain = [i for i, p in enumerate(pieces) if not (self.sp.is_control(i) or self.sp.is_unknown(i) or self.sp.is_byte(i) or self.sp.is_unused(i))]
        self.ids = {pieces[i]: i for i in plain}
        self.score = {pieces[i]: self.sp.get_score(i) for i in plain}
        self.bytes = [self.sp.piece_to_id(f"<0x{b:02X}>") for b in range(256)]
        if any(self.sp.is_unknown(b) for b in self.bytes):
            raise ValueError("the model has no byte pieces")
        self.longest = max(map(len, self.ids))
        self.hard = not any(MARK in p.lstrip(MARK) for p in self.ids)  # no piece has a mark after other text
        probe = self.sp.encode("ab a")
        if self.sp.decode(probe) != "ab a" or self.sp.encode("a  b", out_type=str)[0][0] != MARK:
            raise ValueError("only models that keep blanks and put one before the text are supported")
        self.pairs: dict[tuple[str, str], bool] = {}
        self.words = _Words(self)

    def merge(self, text: str) -> list[str]:
        """Greedy merging of a short text: at each step the best-ranked pair of neighbours, the leftmost of equals."""
        parts = list(text)
        while True:
            best = max(((self.score[a + b], -i) for i, (a, b) in enumerate(zip(parts, parts[1:])) if a + b in self.score), default=None)
            if best is None:
                return parts
            i = -best[1]
            parts[i : i + 2] = [parts[i] + parts[i + 1]]

    def step(self, a: str, b: str) -> bool:
        """Whether piece b may follow piece a."""
        key = (a, b)
        if key not in self.pairs:
            if len(self.pairs) > 50_000:
                self.pairs.clear()
            self.pairs[key] = (len(a) == 1 and a not in self.ids) or (len(b) == 1 and b not in self.ids) or self.merge(a + b) == [a, b]
        return self.pairs[key]

    def numbers(self, pieces: list[str]) -> list[int]:
        out: list[int] = []
        for p in pieces:
            if p in self.ids:
                out.append(self.ids[p])
            else:
                out += [self.bytes[b] for b in p.encode()]
        return out

    def encode(self, marked: str) -> list[int]:
        """Ids of a text that starts with a word mark, by the one path from its start to its end."""
        if self.library:
            return self.sp.encode(marked[1:].replace(MARK, " ")) if marked else []  # the library puts the first mark back
        if not self.hard:
            return self.trace(marked)
        return list(chain.from_iterable(map(self.words.__getitem__, _STRETCH.findall(marked))))

    def trace(self, marked: str) -> list[int]:
        return self.numbers(back(self.walk(marked, 0, None, len(marked)), 0, len(marked)))

    def around(self, text: str, at: int) -> list[tuple[str, int]]:
        """States at a border: (piece, end) of every piece that could hold the character before `at`."""
        out = []
        for start in range(max(0, at - self.longest), at):
            for end in range(at, min(len(text), start + self.longest) + 1):
                p = text[start:end]
                if (p in self.ids or end - start == 1) and self.merge(p) == [p]:
                    out.append((p, end))
        return out

    def walk(self, text: str, start: int, first: str | None, stop: int) -> dict[int, str]:
        """Position -> last piece of the one path from `start`, where `first` has ended, to that position."""
        last: dict[int, str | None] = {start: first}
        for at in range(start + 1, stop + 1):
            for n in range(1, min(self.longest, at - start) + 1):
                before = at - n
                if before in last:
                    p = text[before:at]
                    if (n == 1 or p in self.ids) and (last[before] is None or self.step(last[before], p)) and (n == 1 or self.merge(p) == [p]):
                        last[at] = p
                        break
        return last


class _Words(dict):
    """Ids of stretches that no piece crosses the ends of; MOST short ones are kept, a worker then starts anew."""

    MOST, LONGEST = 100_000, 48

    def __init__(self, coder: Coder):
        self.coder = coder

    def __missing__(self, stretch: str) -> list[int]:
        ids = self.coder.trace(stretch)
        if len(stretch) <= self.LONGEST:
            if len(self) >= self.MOST:
                self.clear()
            self[stretch] = ids
        return ids


def back(path: dict, start: int, end: int) -> list[str]:
    """The pieces of a path, from its end."""
    out = []
    while end > start:
        out.append(path[end])
        end -= len(path[end])
    return out[::-1]


def breaks(text: str, start: int, stop: int) -> tuple[int, int]:
    """The first and the last position in [start, stop] where no piece crosses, or (-1, -1)."""
    first = last = -1
    at = start
    while 0 <= (at := text.find(MARK, at, stop)):
        if at and text[at - 1] != MARK:
            first = at
            break
        at += 1
    if first >= 0:
        at = stop
        while True:
            at = text.rfind(MARK, first, at)
            if text[at - 1] != MARK:
                last = at
                break
    return first, last


class Chunk:
    """One chunk with its surroundings: text[left:right] is its own, and `longest` characters on both sides show."""

    def __init__(self, coder: Coder, text: str, left: int, right: int, is_first: bool, is_last: bool):
        self.c, self.text, self.left, self.right = coder, text, left, right
        self.starts: list[tuple[str | None, int]] = [(None, left)] if is_first else coder.around(text, left)
        self.ends: list[tuple[str, int]] = [(text[right - 1 : right], right)] if is_last else coder.around(text, right)
        self.is_last = is_last
        self.first, self.last = breaks(text, left + coder.longest, right - coder.longest) if coder.hard else (-1, -1)

    def _head(self, state):
        piece, end = state
        return self.c.walk(self.text, end, piece, self.first if self.first >= 0 else max(e for _, e in self.ends))

    def _tail(self):
        return self.c.walk(self.text, self.last, None, max(e for _, e in self.ends))

    def _end_in(self, path: dict, state) -> bool:
        """Whether a path ends in a state at the right border; the text's end takes whatever piece came last."""
        piece, end = state
        return end in path and (self.is_last or path[end] == piece)

    def matrix(self) -> np.ndarray:
        out = np.full((len(self.starts), len(self.ends)), LOW)
        tail = self._tail() if self.first >= 0 else None
        for i, s in enumerate(self.starts):
            head = self._head(s)
            if tail is None:
                # a piece may reach over the whole chunk only if chunks are shorter than pieces, which encode() forbids
                out[i] = [0.0 if self._end_in(head, e) else LOW for e in self.ends]
            elif self.first in head:
                out[i] = [0.0 if self._end_in(tail, e) else LOW for e in self.ends]
        return out

    def trace(self, start: int, end: int) -> list[int]:
        """Ids of the pieces after the state `start`, up to and with the state `end`."""
        s, e = self.starts[start], self.ends[end]
        head = self._head(s)
        if self.first < 0:
            return self.c.numbers(back(head, s[1], e[1]))
        ids = self.c.numbers(back(head, s[1], self.first))
        ids += self.c.encode(self.text[self.first : self.last])
        return ids + self.c.numbers(back(self._tail(), self.last, e[1]))


def product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Max-plus product of two matrices, or of a row and a matrix."""
    return (a[..., :, None] + b).max(axis=-2)


def _coder(model: bytes, library: bool = True) -> Coder:
    global _kept
    if _kept is None or _kept[0] != model:
        _kept = (model, Coder(model))
    _kept[1].library = library
    return _kept[1]


_kept: tuple[bytes, Coder] | None = None


def _model_bytes(model: str | None) -> bytes:
    with open(model or default_model(), "rb") as f:
        return f.read()


def _pack(m: np.ndarray) -> bytes:
    return np.asarray(m.shape, "<i4").tobytes() + m.astype("<f8").tobytes()


def _unpack(b: bytes) -> np.ndarray:
    shape = np.frombuffer(b, "<i4", 2)
    return np.frombuffer(b, "<f8", offset=8).reshape(shape)


def _chunks(df: DataFrame, key: str, text: str, chunk: int, margin: int) -> DataFrame:
    """(key, n, no, lead, part) of texts over one chunk, with the surroundings that show, dealt out by chunk and written;
    the text has the library's way of marking blanks. Each text is cut in one go."""

    def cut(batches):
        for batch in batches:
            for name, t in zip(batch.column(0), batch.column(1)):
                t = MARK + t.as_py().replace(" ", MARK)
                n = -(-len(t) // chunk)
                for first in range(0, n, 64):
                    numbers = range(first, min(n, first + 64))
                    lead = [min(k * chunk, margin) for k in numbers]
                    parts = [t[k * chunk - d : (k + 1) * chunk + margin] for k, d in zip(numbers, lead)]
                    yield pa.RecordBatch.from_arrays([pa.array([name.as_py()] * len(lead), name.type), pa.array([n] * len(lead), pa.int32()), pa.array(list(numbers), pa.int32()), pa.array(lead, pa.int32()), pa.array(parts, pa.string())], names=["key", "n", "no", "lead", "part"])

    rows = df.select(F.col(key).alias("key"), F.col(text).alias("t"))
    kind = rows.schema["key"].dataType.simpleString()
    return written(rows.mapInArrow(cut, f"key {kind}, n int, no int, lead int, part string").repartition("key", "no"), "sp-chunks")


def encode(df: DataFrame, key: str, text: str, model: str | None = None, chunk_chars: int = CHUNK, library: bool = True) -> DataFrame:
    """`df` with ids array<int>, n_ids bigint and n_chunks int.

    The step-by-step recursion takes all of a text if not `library`. Every row stays, whatever its `key`: keys may be null or repeat, as rows of long texts get a number of their own. The
    ids are those of the library's own encoder. A null text has null ids (and no chunk), an empty one an empty array.
    Columns of these names are replaced. Texts over one chunk are written with their row's number and dealt out by
    chunk: no task handles one as a whole before its ids are put together in its row.
    """
    data = _model_bytes(model)
    margin = 2 * Coder(data).longest
    if chunk_chars < 4 * margin:
        raise ValueError(f"chunk_chars must be {4 * margin} at least")
    keep = without(df, "ids", "n_ids", "n_chunks")
    base = df.select(*[df[c] for c in keep])
    is_large = F.coalesce(F.length(base[text]) >= chunk_chars, F.lit(False))
    small = _encode_small(base.where(~is_large), text, data, library)
    row = "__row"
    while row in {c.lower() for c in keep}:
        row += "_"
    # the numbers hold only once they are written: another run of the same plan may deal them out otherwise
    storable = [c for c, kind in base.dtypes if kind != "void"]
    large = written(base.where(is_large).select(*[base[c] for c in storable], F.monotonically_increasing_id().alias(row)), "sp-large")
    big = large.join(_encode_large(large, row, text, data, chunk_chars, margin, library), row)
    big = big.withColumns({c: F.lit(None) for c in keep if c not in storable})
    return small.unionByName(big.select(*small.columns))


def _encode_small(base: DataFrame, text: str, data: bytes, library: bool) -> DataFrame:
    """Texts of one chunk: from the text's start to its end there is one state at either border."""
    schema = T.StructType([*base.schema.fields, T.StructField("ids", T.ArrayType(T.IntegerType())), T.StructField("n_ids", T.LongType()), T.StructField("n_chunks", T.IntegerType())])

    def each(batches):
        coder = _coder(data, library)
        for batch in batches:
            column = batch.column(batch.schema.names.index(text))
            # a slice at a time goes back, so that a worker never holds the ids of a whole batch
            for start, end in text_slices(column):
                texts = column.slice(start, end - start).to_pylist()
                lists = [np.asarray(coder.encode(MARK + t.replace(" ", MARK)) if t else [], "i4") for t in texts]
                sizes = np.array([len(x) for x in lists], "i8")
                missing = np.array([t is None for t in texts], bool)
                packed = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype("i4")), pa.array(np.concatenate(lists)), mask=pa.array(missing))
                yield pa.RecordBatch.from_arrays([*batch.slice(start, end - start).columns, packed, pa.array(sizes, mask=missing), pa.array((~missing).astype("i4"))], names=[*batch.schema.names, "ids", "n_ids", "n_chunks"])
        give_back()

    return base.mapInArrow(each, schema)


def _encode_large(base: DataFrame, key: str, text: str, data: bytes, chunk: int, margin: int, library: bool) -> DataFrame:
    parts = _chunks(base, key, text, chunk, margin)
    kind = parts.schema["key"].dataType.simpleString()

    def few_rows(batches):
        for batch in batches:
            for start in range(0, batch.num_rows, 8):
                yield batch.slice(start, 8)
        give_back()

    def whole(row):
        left = row["lead"]
        return Chunk(_coder(data, library), row["part"], left, min(left + chunk, len(row["part"])), row["no"] == 0, row["no"] == row["n"] - 1)

    def matrices(batches):
        for batch in few_rows(batches):
            made = [_pack(whole(r).matrix()) for r in batch.to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("key"), batch.column("n"), batch.column("no"), pa.array(made, pa.binary())], names=["key", "n", "no", "m"])

    m = written(parts.mapInArrow(matrices, f"key {kind}, n int, no int, m binary"), "sp-matrices")
    m = m.withColumn("block", F.floor(F.col("no") / BLOCK).cast("int"))

    def multiply(t: pa.Table) -> pa.Table:
        t = t.sort_by("no")
        total = None
        for b in t.column("m").to_pylist():
            total = _unpack(b) if total is None else product(total, _unpack(b))
        return pa.table({"key": t.column("key")[:1], "block": t.column("block")[:1], "m": pa.array([_pack(total)], pa.binary())})

    # A row of a string column holds 2 GB at most: a text has some 65,000 chunks, some 260 blocks.
    def over_blocks(t: pa.Table) -> pa.Table:
        t = t.sort_by("block")
        ms = [_unpack(b) for b in t.column("m").to_pylist()]
        ahead, behind = [np.zeros(ms[0].shape[0])], [np.zeros(ms[-1].shape[1])]
        for x in ms:
            ahead.append(product(ahead[-1], x))
        for x in reversed(ms):
            behind.append(product(behind[-1], x.T))
        behind.reverse()
        return pa.table({"key": t.column("key"), "block": t.column("block"), "ahead": pa.array([v.astype("<f8").tobytes() for v in ahead[:-1]], pa.binary()), "behind": pa.array([v.astype("<f8").tobytes() for v in behind[1:]], pa.binary())})

    blocks = m.groupBy("key", "block").applyInArrow(multiply, f"key {kind}, block int, m binary")
    borders = blocks.groupBy("key").applyInArrow(over_blocks, f"key {kind}, block int, ahead binary, behind binary")

    def inside(t: pa.Table) -> pa.Table:
        """The states at the chunks' borders: where the best weight from the start plus the best to the end is largest."""
        t = t.sort_by("no")
        ms = [_unpack(b) for b in t.column("m").to_pylist()]
        ahead = [np.frombuffer(t.column("ahead")[0].as_py(), "<f8")]
        behind = [np.frombuffer(t.column("behind")[0].as_py(), "<f8")]
        for x in ms:
            ahead.append(product(ahead[-1], x))
        for x in reversed(ms):
            behind.append(product(behind[-1], x.T))
        states = [int((a + b).argmax()) for a, b in zip(ahead, reversed(behind))]
        if any((a + b).max() == LOW for a, b in zip(ahead, reversed(behind))):
            raise RuntimeError("no path through the chunks of a text")
        return pa.table({"key": t.column("key"), "no": t.column("no"), "s": pa.array(states[:-1], pa.int32()), "e": pa.array(states[1:], pa.int32())})

    states = m.join(borders, ["key", "block"]).select("key", "block", "no", "m", "ahead", "behind").groupBy("key", "block").applyInArrow(inside, f"key {kind}, no int, s int, e int")

    def trace(batches):
        for batch in few_rows(batches):
            made = [np.asarray(whole(r).trace(r["s"], r["e"]), "i4") for r in batch.to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("key"), batch.column("n"), batch.column("no"), pa.array(made, pa.list_(pa.int32()))], names=["key", "n", "no", "ids"])

    traced = parts.join(states, ["key", "no"]).select("key", "n", "no", "lead", "part", "s", "e").mapInArrow(trace, f"key {kind}, n int, no int, ids array<int>")
    rows = traced.groupBy("key").agg(F.max("n").alias("n_chunks"), F.sort_array(F.collect_list(F.struct("no", "ids"))).alias("x"))
    ids = F.flatten(F.transform("x", lambda x: x["ids"]))
    return rows.select(F.col("key").alias(key), ids.alias("ids"), F.size(ids).cast("bigint").alias("n_ids"), "n_chunks")


def decode(df: DataFrame, ids: str = "ids", to: str = "decoded", model: str | None = None) -> DataFrame:
    """`df` with the text of an array of ids. Null ids give null. Byte pieces that are not UTF-8 give U+FFFD; an
    id outside the vocabulary is an error. A column named as `to` is replaced."""
    data = _model_bytes(model)
    keep = without(df, to)
    base = df.select(*[df[c] for c in keep])

    def each(batches):
        sp = _coder(data).sp
        for batch in batches:
            column = batch.column(batch.schema.names.index(ids))
            for start, end in slices(pc.fill_null(pc.list_value_length(column), 0).to_pylist(), 1 << 18):
                texts = [None if x is None else sp.decode(x) if x else "" for x in column.slice(start, end - start).to_pylist()]
                yield pa.RecordBatch.from_arrays([*batch.slice(start, end - start).columns, pa.array(texts, pa.string())], names=[*batch.schema.names, to])
        give_back()

    return base.mapInArrow(each, T.StructType([*base.schema.fields, T.StructField(to, T.StringType())]))


def summary(coded: DataFrame, key: str, text: str, model: str | None = None) -> DataFrame:
    """key, n_ids, n_chunks, ids_digest (hash of the ids) and round_trip: whether decoding gives the text, with the
    word mark read as a blank (the vocabulary has one piece for both)."""
    back = decode(coded, "ids", "__back", model)
    same = F.col("__back").eqNullSafe(F.replace(F.col(text), F.lit(MARK), F.lit(" ")))
    return back.select(key, "n_ids", "n_chunks", F.xxhash64("ids").alias("ids_digest"), same.alias("round_trip"))
