"""Byte-level BPE by sentencepiece, and token counts that make no ids (operators 2 and 5)."""

from __future__ import annotations

import base64
import functools
import struct
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm import common, kernels

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
SLICE = 1 << 20
CACHED = 100_000
COUNTED = 2_000_000
PORTION = 20_000


def read_vocabulary(path: str = VOCABULARY) -> bytes:
    """The vocabulary file (a line of base64 and rank for each piece), compressed for closures."""
    with open(path, "rb") as f:
        return zlib.compress(f.read(), 6)


@functools.cache
def byte_signs() -> list[str]:
    """A printable sign for each byte: itself where it is one, else one from 256 on."""
    plain = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    moved = iter(range(256, 512))
    return [chr(b if b in plain else next(moved)) for b in range(256)]


def _varint(n: int) -> bytes:
    n &= (1 << 64) - 1
    out = bytearray()
    while n > 0x7F:
        out.append(n & 0x7F | 0x80)
        n >>= 7
    out.append(n)
    return bytes(out)


def _field(number: int, value: bytes | int) -> bytes:
    if isinstance(value, int):
        return _varint(number << 3) + _varint(value)
    return _varint(number << 3 | 2) + _varint(len(value)) + value


def model_proto(pieces: list[bytes]) -> bytes:
    """A sentencepiece BPE model whose piece i+1 is pieces[i] with score -i.

    Bytes are written as their signs; piece 0 is the unknown piece, which never occurs as
    every byte is a piece.  Normalisation is the identity: no prefix, no change of spaces.
    """
    signs = str.maketrans({b: s for b, s in enumerate(byte_signs())})
    out = [_field(1, _field(1, b"<unk>") + b"\x15" + struct.pack("<f", 0.0) + _field(3, 2))]
    for rank, piece in enumerate(pieces):
        name = piece.decode("latin-1").translate(signs).encode()
        out.append(_field(1, _field(1, name) + b"\x15" + struct.pack("<f", -float(rank)) + _field(3, 1)))
    bpe = 2
    trainer = _field(3, bpe) + _field(4, len(pieces) + 1) + _field(35, 0) + _field(40, 0) + _field(41, -1) + _field(42, -1) + _field(43, -1)
    normal = _field(1, b"identity") + _field(3, 0) + _field(4, 0) + _field(5, 0)
    return b"".join(out) + _field(2, trainer) + _field(3, normal)


def _bytes(text: str) -> bytes:
    """The bytes of a text or pre-token of a slice, those that are no UTF-8 too."""
    return text.encode("utf-8", "surrogateescape")


class Codec:
    """Encode pre-tokens and decode ids for one vocabulary."""

    def __init__(self, packed: bytes):
        import sentencepiece

        lines = [x.split() for x in zlib.decompress(packed).splitlines() if x.strip()]
        ranked = sorted((int(r), base64.b64decode(p)) for p, r in lines)
        self.pieces = [p for _, p in ranked]
        self.rank = {p: r for r, p in ranked}
        self.ids = np.array([0] + [r for r, _ in ranked], np.int32)  # from sentencepiece's numbers
        self.table = np.full(ranked[-1][0] + 1, b"", object)
        self.table[self.ids[1:]] = self.pieces
        self.length = np.fromiter(map(len, self.table), np.int64, len(self.table))
        self.flat = np.frombuffer(b"".join(self.table.tolist()), np.uint8)
        self.start = np.cumsum(self.length) - self.length
        self.model = sentencepiece.SentencePieceProcessor(model_proto=model_proto(self.pieces))
        self.signs = str.maketrans({b: s for b, s in enumerate(byte_signs())})
        self.kept: dict[str, bytes] = {}

    def _encoded(self, tokens: list[str]) -> list[list[int]]:
        return self.model.encode([_bytes(t).decode("latin-1").translate(self.signs) for t in tokens], out_type=int, num_threads=1)

    def encode(self, tokens: list[str]) -> list[bytes]:
        """The ids of each pre-token, as the bytes of 32-bit numbers.  Frequent ones are kept."""
        if len(self.kept) > CACHED:
            self.kept.clear()
        new = [t for t in tokens if t not in self.kept]
        for i in range(0, len(new), PORTION):
            part = new[i : i + PORTION]
            for t, found in zip(part, self._encoded(part)):
                self.kept[t] = self.ids[found].tobytes()
        return [self.kept[t] for t in tokens]

    def alone(self) -> bool:
        """Whether each piece that is UTF-8 is encoded as itself, as it is where each merge's result ranks behind its parts."""
        whole = [p for p in self.pieces if p.decode("utf-8", "ignore").encode() == p]
        return all(self.count([p.decode() for p in whole[i : i + PORTION]]).max(initial=1) == 1 for i in range(0, len(whole), PORTION))

    def count(self, tokens: list[str]) -> np.ndarray:
        """The number of pieces of each pre-token."""
        return np.fromiter(map(len, self._encoded(tokens)), np.int64, len(tokens)) if tokens else np.zeros(0, np.int64)

    def decode(self, ids: Iterable[int]) -> bytes:
        """The bytes that ids stand for: each piece back from its rank, joined."""
        return self.decode_all(np.fromiter(ids, np.int64)).tobytes()

    def decode_all(self, ids: np.ndarray) -> np.ndarray:
        if len(ids) and not (0 <= ids.min() and ids.max() < len(self.table)):
            raise IndexError("an id is outside the vocabulary")
        return self.flat[kernels.ragged(self.start[ids], self.length[ids])]


@functools.lru_cache(maxsize=2)
def codec(packed: bytes) -> Codec:
    return Codec(packed)


def distinct_pretokens(part: kernels.Slice) -> tuple[list[str], np.ndarray, np.ndarray, np.ndarray]:
    """Distinct pre-tokens of a slice, their hashes, the one at each place, and the places."""
    start = kernels.pretoken_starts(part)
    end = np.append(start[1:], len(part.points))
    _, first, inverse = np.unique(hashes := kernels.span_hashes(part.points, start, end), return_index=True, return_inverse=True)
    text = part.text
    found = [text[a:b] for a, b in zip(start[first].tolist(), end[first].tolist())]
    return found, hashes[first], inverse.astype(np.int64), start


ENCODED = T.StructType([T.StructField("ids", T.ArrayType(T.IntegerType(), False)), T.StructField("n_tokens", T.LongType()), T.StructField("round_trip", T.BooleanType())])


def encode_columns(text: pa.Array, packed: bytes) -> tuple[pa.Array, pa.Array, pa.Array]:
    """ids, their number and whether decoding gives the text back, for a column of texts."""
    bpe = codec(packed)
    ids, counts, same = [], [], []
    for part in kernels.slices(text, SLICE, "surrogateescape"):
        tokens, _, inverse, start = distinct_pretokens(part)
        each = bpe.encode(tokens)
        size = np.fromiter(map(len, each), np.int64, len(each)) // 4
        flat = np.frombuffer(b"".join(each), np.int32)
        taken = size[inverse]
        out = flat[kernels.ragged((np.cumsum(size) - size)[inverse], taken)]
        edges = np.zeros(len(inverse) + 1, np.int64)
        np.cumsum(taken, out=edges[1:])
        at = edges[np.searchsorted(start, part.bounds)]
        ids.append(out)
        counts.append(np.diff(at))
        back = bpe.decode_all(out).tobytes()
        if back == _bytes(part.text) and _aligned(part, out, at, bpe):
            same.append(np.ones(part.rows, bool))
        else:
            pairs = zip(at.tolist(), at[1:].tolist(), part.bounds.tolist(), part.bounds[1:].tolist())
            same.append(np.array([bpe.decode(out[a:b].tolist()) == _bytes(part.text[c:d]) for a, b, c, d in pairs], bool))
    counted = np.concatenate(counts) if counts else np.zeros(0, np.int64)
    offsets = np.zeros(len(counted) + 1, np.int32)
    np.cumsum(counted, out=offsets[1:])
    values = pa.array(np.concatenate(ids) if ids else np.zeros(0, np.int32), pa.int32())
    lists = pa.ListArray.from_arrays(pa.array(offsets), values)
    return lists, pa.array(counted, pa.int64()), pa.array(np.concatenate(same) if same else np.zeros(0, bool), pa.bool_())


def _aligned(part: kernels.Slice, out: np.ndarray, at: np.ndarray, bpe: Codec) -> bool:
    """Whether the bytes of each row's ids are as many as its text has."""
    total = np.zeros(len(out) + 1, np.int64)
    np.cumsum(bpe.length[out], out=total[1:])
    points = part.points
    wide = np.zeros(len(points) + 1, np.int64)
    single = (points >= 0xDC80) & (points <= 0xDCFF)  # a byte that is no UTF-8
    np.cumsum(np.where(single, 1, 1 + (points > 0x7F) + (points > 0x7FF) + (points > 0xFFFF)), out=wide[1:])
    return bool(np.array_equal(total[at], wide[part.bounds]))


def encode(docs: DataFrame, vocabulary: str = VOCABULARY, text: str = "text", prefix: str = "") -> DataFrame:
    """docs with the columns ids, n_tokens and round_trip.

    A null text has null ids, n_tokens and round_trip; an empty one has no ids and
    round_trip true.  Bytes that aren't UTF-8 are encoded as they are.  Repeated rows are encoded alike.  Columns of docs named as the new
    ones are replaced by them unless `prefix` makes the new names differ.  Other columns pass.
    """
    packed = read_vocabulary(vocabulary)
    new = [f"{prefix}{f.name}" for f in ENCODED]
    kept = [c for c in docs.columns if c.lower() not in {n.lower() for n in new}]
    plain = [f"c{i}" for i in range(len(kept) + len(new))]  # as mapInArrow takes no names with dots
    schema = T.StructType([T.StructField(n, t) for n, t in zip(plain, [*(docs.schema[c].dataType for c in kept), *(f.dataType for f in ENCODED)])])
    at = [c.lower() for c in kept].index(text.lower())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi in _runs_of_rows(batch.column(at)):
                part = batch.slice(lo, hi - lo)
                column = part.column(at)
                absent = column.is_null().to_numpy(zero_copy_only=False)
                lists, counts, same = encode_columns(column, packed)
                if absent.any():
                    mask = pa.array(absent)
                    lists, counts, same = (pa.compute.if_else(mask, pa.scalar(None, x.type), x) for x in (lists, counts, same))
                yield pa.RecordBatch.from_arrays([*part.columns, lists, counts, same], names=plain)
                del part, column, lists, counts, same
                pa.default_memory_pool().release_unused()  # else a worker holds on to its largest batches

    return docs.select(*[common.quoted(c).alias(p) for c, p in zip(kept, plain)]).mapInArrow(run, schema).toDF(*kept, *new)


def _runs_of_rows(column: pa.Array, limit: int = 4 * SLICE) -> Iterator[tuple[int, int]]:
    """Ranges of rows of about `limit` bytes, so that a result batch stays small."""
    sizes = pa.compute.fill_null(pa.compute.binary_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    ends = np.cumsum(sizes)
    lo = 0
    while lo < len(sizes):
        hi = max(lo + 1, int(np.searchsorted(ends, (ends[lo - 1] if lo else 0) + limit, side="right")))
        yield lo, hi
        lo = hi


def decode(rows: DataFrame, vocabulary: str = VOCABULARY, ids: str = "ids", out: str = "decoded") -> DataFrame:
    """rows with a column of the text that `ids` stand for.

    Null ids give null, no ids the empty text.  An id outside the vocabulary raises.
    The text has the very bytes that the ids stand for, also where they form no UTF-8 (a text that had none, ids cut within a sign).
    """
    packed = read_vocabulary(vocabulary)
    kept = [c for c in rows.columns if c.lower() != out.lower()]
    plain = [f"c{i}" for i in range(len(kept) + 1)]
    schema = T.StructType([T.StructField(n, t) for n, t in zip(plain, [*(rows.schema[c].dataType for c in kept), T.StringType()])])
    at = [c.lower() for c in kept].index(ids.lower())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = codec(packed)
        for batch in batches:
            column = batch.column(at)
            taken = pa.compute.fill_null(pa.compute.list_value_length(column), 0).to_numpy(zero_copy_only=False)
            every = column.flatten()
            if every.null_count:
                raise IndexError("an id is null")
            flat = every.to_numpy(zero_copy_only=False).astype(np.int64)
            raw = bpe.decode_all(flat)
            ends = np.concatenate([[0], np.cumsum(bpe.length[flat])])[np.cumsum(taken)]
            offsets = pa.py_buffer(np.concatenate([[0], ends]).astype(np.int32).tobytes())
            valid = pa.array(column.is_valid().to_numpy(zero_copy_only=False), pa.bool_()).buffers()[1]
            texts = pa.Array.from_buffers(pa.string(), len(column), [valid, offsets, pa.py_buffer(raw.tobytes())])
            yield pa.RecordBatch.from_arrays([*batch.columns, texts], names=plain)

    return rows.select(*[common.quoted(c).alias(p) for c, p in zip(kept, plain)]).mapInArrow(run, schema).toDF(*kept, out)


# --- token counts ---------------------------------------------------------------------------------


def _pack(*arrays: np.ndarray) -> bytes:
    import zstandard

    out = [struct.pack("<B", len(arrays))]
    for x in arrays:
        kind = x.dtype
        if kind == np.int64 and x.min(initial=0) >= 0:
            kind = np.min_scalar_type(int(x.max(initial=0)))
        out.append(struct.pack("<cI", kind.char.encode(), len(x)) + x.astype(kind).tobytes())
    return zstandard.ZstdCompressor(level=3).compress(b"".join(out))


def _unpack(blob: bytes) -> list[np.ndarray]:
    import zstandard

    raw = zstandard.ZstdDecompressor().decompress(blob)
    out, at = [], 1
    for _ in range(raw[0]):
        char, n = struct.unpack_from("<cI", raw, at)
        kind = np.dtype(char.decode())
        out.append(np.frombuffer(raw, kind, n, at + 5))
        at += 5 + n * kind.itemsize
    return out


def token_counts(docs: DataFrame, vocabulary: str = VOCABULARY, buckets_per_partition: int = 4, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_pretokens and n_tokens for each row of docs.

    Each task turns its documents into pre-token frequencies, held inversely: the pre-token
    once, then the documents that have it and how often.  These go to the bucket of the
    pre-token's hash, where its pieces are counted once, multiplied and added up for each document.
    Pre-tokens that are pieces themselves, the frequent ones, count 1 and need not travel.
    No ids are made.

    A null or empty text has 0 of both.  Repeated rows, also with equal ids, are counted each for
    itself, and a null doc_id is kept.  Other columns are not looked at.

    A task's documents are known by their places in it, so docs that are more than a reading of files are written first: a task that
    is repeated must meet the same rows in the same order.
    """
    spark = docs.sparkSession
    packed = read_vocabulary(vocabulary)
    alone = codec(packed).alone()
    width = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    buckets = width * buckets_per_partition

    def frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        rank = codec(packed).rank if alone else {}
        chunk = TaskContext.get().partitionId() << 32
        for batch in batches:
            column = batch.column(1)
            for part in kernels.slices(column, 4 * SLICE, "surrogateescape"):
                names = batch.column(0).slice(part.first, part.rows)
                tokens, hashes, inverse, start = distinct_pretokens(part)
                row = np.searchsorted(part.bounds, start, side="right") - 1
                known = np.fromiter((_bytes(t) in rank for t in tokens), bool, len(tokens))
                total = np.bincount(row, minlength=part.rows)
                single = np.bincount(row[known[inverse]], minlength=part.rows)
                # multi-piece tokens in the order of their buckets
                many = np.flatnonzero(~known)
                bucket = (hashes[many] % np.uint64(buckets)).astype(np.int64)
                order = np.argsort(bucket, kind="stable")
                many, bucket = many[order], bucket[order]
                place = np.full(len(tokens), -1, np.int64)
                place[many] = np.arange(len(many))
                where = place[inverse]
                far = where >= 0
                pair, times = np.unique(where[far] * part.rows + row[far], return_counts=True)
                token, doc = pair // part.rows, pair % part.rows
                length = np.bincount(token, minlength=len(many))
                raw = [_bytes(tokens[i]) for i in many.tolist()]
                size = np.fromiter(map(len, raw), np.int64, len(raw))
                cuts = np.searchsorted(bucket, np.arange(buckets + 1))
                edge = np.concatenate([[0], np.cumsum(length)])
                out = ([0], [chunk], [_head(names, total, single)])
                for b in np.unique(bucket).tolist():
                    i, j = int(cuts[b]), int(cuts[b + 1])
                    s = slice(int(edge[i]), int(edge[j]))
                    body = _pack(np.frombuffer(b"".join(raw[i:j]), np.uint8), size[i:j], length[i:j], doc[s], times[s], np.array([part.rows]))
                    for x, y in zip(out, (b, chunk, b"b" + body)):
                        x.append(y)
                yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.int32()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.binary())], names=["bucket", "chunk", "body"])
                chunk += 1

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = codec(packed)
        pieces: dict[bytes, int] = {}
        sums: dict[int, np.ndarray] = {}
        held = 0

        def give() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int64()), pa.array([b"s" + _pack(x) for x in sums.values()], pa.binary())], names=["chunk", "body"])
            sums.clear()
            return out

        for batch in batches:
            for chunk, body in zip(batch.column("chunk").to_pylist(), batch.column("body").to_pylist()):
                if body[:1] == b"h":
                    yield pa.RecordBatch.from_arrays([pa.array([chunk], pa.int64()), pa.array([body], pa.binary())], names=["chunk", "body"])
                    continue
                raw, size, length, doc, times, rows = _unpack(body[1:])
                end = np.cumsum(size, dtype=np.int64)
                flat = raw.tobytes()
                tokens = [flat[a:b] for a, b in zip((end - size).tolist(), end.tolist())]
                if len(pieces) > COUNTED:
                    pieces.clear()
                new = [t for t in tokens if t not in pieces]
                pieces.update(zip(new, bpe.count([t.decode("utf-8", "surrogateescape") for t in new]).tolist()))
                weight = np.fromiter(map(pieces.__getitem__, tokens), np.int64, len(tokens))
                found = np.bincount(doc, weights=np.repeat(weight, length) * times, minlength=int(rows[0])).astype(np.int64)
                if chunk in sums:
                    sums[chunk] = sums[chunk] + found
                else:
                    sums[chunk] = found
                    held += len(found)
                if held > 4_000_000:
                    yield give()
                    held = 0
        if sums:
            yield give()

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        heads: dict[int, bytes] = {}
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for chunk, body in zip(batch.column("chunk").to_pylist(), batch.column("body").to_pylist()):
                if body[:1] == b"h":
                    heads[chunk] = body
                else:
                    x = _unpack(body[1:])[0].astype(np.int64)
                    sums[chunk] = sums[chunk] + x if chunk in sums else x
        for chunk, body in heads.items():
            absent, low, names, total, single = _unpack(body[1:])
            ids = pa.array(np.cumsum(names.astype(np.int64)) + low.astype(np.int64), pa.int64(), mask=absent.astype(bool))
            tokens = single.astype(np.int64) + sums.get(chunk, 0)
            yield pa.RecordBatch.from_arrays([ids, pa.array(total.astype(np.int64)), pa.array(tokens)], names=["doc_id", "n_pretokens", "n_tokens"])

    slim = common.steady(docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")))
    first = slim.mapInArrow(frequencies, "bucket int, chunk long, body binary")
    second = first.repartition(width, "bucket").mapInArrow(weigh, "chunk long, body binary")
    return second.repartition(width, "chunk").mapInArrow(finish, "doc_id long, n_pretokens long, n_tokens long")


def _head(names: pa.Array, total: np.ndarray, single: np.ndarray) -> bytes:
    """A chunk's ids as differences, with its numbers of pre-tokens and of those of one piece."""
    absent = names.is_null().to_numpy(zero_copy_only=False)
    ids = pa.compute.fill_null(names, 0).to_numpy(zero_copy_only=False).astype(np.int64)
    return b"h" + _pack(absent.astype(np.uint8), ids[:1], np.diff(ids, prepend=ids[:1]), total.astype(np.int64), single.astype(np.int64))
