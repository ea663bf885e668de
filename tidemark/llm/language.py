"""Language identification by compression with per-language dictionaries (operator 6)."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

DICTIONARY = 64 << 10
SAMPLE = 400
PIECE = 1000
CHUNK = 4096
LEVEL = 6
MARGIN = 0.01
MARGIN_BYTES = 3
UNKNOWN = "und"


def train(docs: DataFrame, sample: int = SAMPLE, size: int = DICTIONARY) -> dict[str, bytes]:
    """A raw-content dictionary of at most `size` bytes for each value of lang.

    The texts of at most `sample` rows of the language, those of the lowest hash of doc_id, are put in lower case and
    parted into pieces of at most PIECE signs.  Pieces from all of them, in order of their hash, make up the dictionary while they fit.
    Rows without text or language are not used; no usable rows give no dictionaries.
    """
    order = W.partitionBy("lang").orderBy(F.xxhash64("doc_id"), "doc_id")
    usable = docs.select("doc_id", "lang", "text").where("lang is not null and text is not null and length(text) > 0")
    chosen = usable.select("doc_id", "lang").where("doc_id is not null").withColumn("n", F.row_number().over(order)).where(F.col("n") <= sample)
    chosen = F.broadcast(chosen.select(F.col("doc_id").alias("i"), F.col("lang").alias("l")))  # sample rows for each language
    texts = usable.join(chosen, (F.col("doc_id") == F.col("i")) & (F.col("lang") == F.col("l")), "left_semi")
    piece = F.explode(F.regexp_extract_all(F.lower("text"), F.lit(f"(?s).{{1,{PIECE}}}"), F.lit(0)))
    pieces = texts.select("lang", "doc_id", piece.alias("piece")).select("lang", F.xxhash64("doc_id", "piece").alias("h"), "piece")

    def pack(key: tuple, rows: pa.Table) -> pa.Table:
        out, left = [], size
        for x in rows.sort_by([("h", "ascending"), ("piece", "ascending")]).column("piece"):
            raw = x.as_py().encode() + b"\n"
            if len(raw) <= left:
                out.append(raw)
                left -= len(raw)
        return pa.table({"lang": pa.array([key[0].as_py()]), "d": pa.array([b"".join(out)], pa.binary())})

    return {r.lang: bytes(r.d) for r in pieces.groupBy("lang").applyInArrow(pack, "lang string, d binary").collect()}  # a row for each language


class Compressors:
    def __init__(self, dictionaries: dict[str, bytes], level: int = LEVEL):
        import zstandard as z

        self.languages = sorted(dictionaries)
        self.each = []
        for name in self.languages:
            d = z.ZstdCompressionDict(dictionaries[name], dict_type=z.DICT_TYPE_RAWCONTENT)
            d.precompute_compress(level=level)
            self.each.append(z.ZstdCompressor(level=level, dict_data=d, write_content_size=False, write_dict_id=False))

    def sizes(self, text: bytes, chunk: int = CHUNK) -> np.ndarray:
        """Compressed bytes of the whole text with each language's dictionary, chunk by chunk.

        Bytes that aren't UTF-8 count as replacement signs.
        """
        raw = text.decode("utf-8", "replace").lower().encode("utf-8")
        parts = [raw[i : i + chunk] for i in range(0, len(raw), chunk)]
        return np.array([sum(len(c.compress(p)) for p in parts) for c in self.each], np.int64)


def decide(sizes: np.ndarray, margin: float = MARGIN, margin_bytes: int = MARGIN_BYTES) -> tuple[int, float]:
    """The place of the least size, or -1 when the next is not far enough, and the margin as a share of that."""
    if len(sizes) < 2:
        return -1, 0.0
    order = np.argsort(sizes, kind="stable")
    gap = int(sizes[order[1]] - sizes[order[0]])
    share = gap / max(1, int(sizes[order[1]]))
    return (int(order[0]) if gap >= margin_bytes and share >= margin else -1), share


def identify(docs: DataFrame, dictionaries: dict[str, bytes], margin: float = MARGIN, margin_bytes: int = MARGIN_BYTES) -> DataFrame:
    """doc_id, language and margin for each row of docs.

    The whole text is compressed with each language's dictionary; the smallest wins.  Where the next
    is nearer than margin_bytes or the share `margin`, the language is "und": so it is for null, empty and
    very short texts, and when fewer than two languages are known.  Repeated rows and null ids
    are kept.  Columns besides doc_id and text are not looked at.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tool = Compressors(dictionaries)
        for b in batches:
            found, share = [], []
            for text in b.column(1).cast(pa.binary()):
                k, m = decide(tool.sizes(text.as_py() or b""), margin, margin_bytes)
                found.append(tool.languages[k] if k >= 0 else UNKNOWN)
                share.append(m)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(found, pa.string()), pa.array(share, pa.float64())], names=["doc_id", "language", "margin"])

    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").alias("text"))
    return slim.mapInArrow(run, "doc_id long, language string, margin double")
