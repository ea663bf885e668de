"""BM25 ranking of texts, any of the query's words being enough.

A search without an index reads the text column once and shuffles a few sums only; with an index it
reads the postings of the query's terms.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.text import query_tokens, tokens
from tidemark.operators.reads import Key
from tidemark.plans.lineage import cut


@dataclass(frozen=True)
class Bm25:
    k1: float = 1.2
    b: float = 0.75

    def part(self, tf: Column, df: Column, dl: Column, n: Column, total: Column) -> Column:
        """One query word's part of the score."""
        n = n.cast("double")
        idf = F.greatest(F.lit(0.0), F.log((n - df + F.lit(0.5)) / (df + F.lit(0.5)) + F.lit(1.0)))
        return idf * tf * F.lit(self.k1 + 1) / (tf + F.lit(self.k1) * (F.lit(1 - self.b) + F.lit(self.b) * dl * n / total))


def term_frequencies(df: DataFrame, key: Key, text: Column) -> DataFrame:
    """The key, dl (tokens of the document), term, tf and whether it is the document's first term here, for each term of each row.

    A row's tokens are sorted, and each run of equal ones counted, within the row: nothing is shuffled, and no Python worker holds a batch of texts.
    """
    t, s = F.col("__t"), F.col("__s")
    # generators, so that the sorted tokens and the starts of their runs are made once for each row and not for each use
    rows = df.select(*key, F.inline(F.array(F.struct(F.sort_array(tokens(text)).alias("__t"))))).where(F.size(t) > 0)
    starts = F.filter(F.sequence(F.lit(0), F.size(t) - 1), lambda i: (i == 0) | (F.get(t, i) != F.get(t, i - 1)))
    rows = rows.select(*key, "__t", F.inline(F.array(F.struct(starts.alias("__s")))))

    def run(at: Column, i: Column) -> Column:
        tf = (F.coalesce(F.get(s, i + 1), F.size(t)) - at).cast("long")
        return F.struct(F.size(t).alias("dl"), F.get(t, at).alias("term"), tf.alias("tf"), (i == 0).alias("first"))

    return rows.select(*key, F.inline(F.transform(s, run)))


def doc_stats(df: DataFrame, key: Key, text: Column) -> DataFrame:
    """The key and dl of each row that has a token; others don't count as documents."""
    return df.select(*key, F.size(tokens(text)).cast("long").alias("dl")).where("dl > 0")


def doc_frequencies(df: DataFrame, key: Key, text: Column) -> DataFrame:
    """term and df, the number of rows that have it."""
    rows = df.select(F.explode(F.array_distinct(tokens(text))).alias("term"))
    return rows.groupBy("term").agg(F.count("*").alias("df"))


def _is(word: str) -> Callable[[Column], Column]:
    return lambda x: x == F.lit(word)


def search(df: DataFrame, key: Key, text: Column, query: str, limit: int | None = None, bm25: Bm25 = Bm25()) -> DataFrame:
    """The key and score of the rows that have a word of the query, best first, then by key.

    A word that the query repeats counts as often.  An empty query finds nothing.
    """
    words = query_tokens(df.sparkSession, query)
    terms = list(dict.fromkeys(words))
    none = df.select(*key).where(F.lit(False)).withColumn("score", F.lit(0.0))
    if not terms:
        return none
    # generators, so that no filter is merged with the tokens and splits a text again for each of its words
    rows = df.select(*key, F.inline(F.array(F.struct(tokens(text).alias("__t")))))
    counts = F.struct(F.size("__t").alias("__dl"), *[F.size(F.filter("__t", _is(w))).alias(f"__f{i}") for i, w in enumerate(terms)])
    rows = cut(rows.select(*key, F.inline(F.array(counts))).where("__dl > 0"))  # a few numbers for each row, read twice
    stats = rows.agg(F.count("*").alias("__n"), F.sum("__dl").alias("__total"), *[F.count_if(F.col(f"__f{i}") > 0).alias(f"__d{i}") for i in range(len(terms))])
    some = reduce(lambda a, b: a | b, (F.col(f"__f{i}") > 0 for i in range(len(terms))))
    scored = rows.where(some).crossJoin(F.broadcast(stats))  # stats is one row
    parts = [bm25.part(F.col(f"__f{terms.index(w)}"), F.col(f"__d{terms.index(w)}"), F.col("__dl"), F.col("__n"), F.col("__total")) for w in words]
    out = scored.select(*key, reduce(lambda a, b: a + b, parts).alias("score")).orderBy(F.col("score").desc(), *key)
    return out if limit is None else out.limit(limit)


class TextIndex:
    """Postings of a table: the key, dl, term, tf and first of each term of each document.

    Held at a path, they are segments, each sorted by term: a task writes those of its own rows, so building
    shuffles nothing and a frequent term is spread over all of them, while a search reads the row groups of its terms alone.
    """

    def __init__(self, postings: DataFrame, key: Key, text: Column, n: int, total: int, path: str | None = None):
        self.postings, self.key, self.text, self.n, self.total, self.path = postings, key, text, n, total, path

    @classmethod
    def build(cls, df: DataFrame, key: Key, text: Column, path: str | None = None) -> TextIndex:
        """The index of df, held in a Parquet table below `path` if that is given."""
        postings = cls._held(term_frequencies(df, key, text), path)
        return cls(postings, key, text, *cls._sums(postings), path)

    @staticmethod
    def _held(postings: DataFrame, path: str | None) -> DataFrame:
        if not path:
            return cut(postings)
        at = f"{path.rstrip('/')}/{uuid.uuid4().hex}"
        postings.sortWithinPartitions("term").write.parquet(at)
        return postings.sparkSession.read.schema(postings.schema).parquet(at)

    @staticmethod
    def _sums(postings: DataFrame) -> tuple[int, int]:
        r = postings.where("first").agg(F.count("*").alias("n"), F.coalesce(F.sum("dl"), F.lit(0)).alias("total")).first()
        return r.n, r.total

    def updated(self, rows: DataFrame, keys: DataFrame) -> TextIndex:
        """The index after `keys` have gone and `rows` have come; what isn't changed isn't read but for the terms of a search.

        The postings of changed documents leave by an anti-join, those of the new ones are a segment more.
        """
        gone = cut(keys.select(*self.key).distinct())
        n, total = self._sums(self.postings.join(gone, list(self.key), "left_semi"))
        fresh = self._held(term_frequencies(rows, self.key, self.text), self.path)
        more, longer = self._sums(fresh)
        kept = self.postings.join(gone, list(self.key), "left_anti").select(*fresh.columns)
        return TextIndex(kept.unionByName(fresh), self.key, self.text, self.n - n + more, self.total - total + longer, self.path)

    def unindex(self, keys: DataFrame) -> TextIndex:
        """The index without the documents of `keys`."""
        gone = cut(keys.select(*self.key).distinct())
        n, total = self._sums(self.postings.join(gone, list(self.key), "left_semi"))
        return TextIndex(self.postings.join(gone, list(self.key), "left_anti"), self.key, self.text, self.n - n, self.total - total, self.path)

    def merged(self) -> TextIndex:
        """The same with all postings in new segments, without anti-joins."""
        return TextIndex(self._held(self.postings, self.path), self.key, self.text, self.n, self.total, self.path)

    def search(self, query: str, limit: int | None = None, bm25: Bm25 = Bm25()) -> DataFrame:
        words = query_tokens(self.postings.sparkSession, query)
        times = {w: words.count(w) for w in words}
        hits = self.postings.where(F.col("term").isin(list(times)))
        df = F.broadcast(hits.groupBy("term").agg(F.count("*").alias("df")))  # a row for each query word
        weight = F.create_map(*[F.lit(x) for w, n in times.items() for x in (w, float(n))])[F.col("term")] if times else F.lit(0.0)
        part = bm25.part(F.col("tf"), F.col("df"), F.col("dl"), F.lit(self.n), F.lit(max(1, self.total))) * weight
        out = hits.join(df, "term").groupBy(*self.key).agg(F.sum(part).alias("score")).orderBy(F.col("score").desc(), *self.key)
        return out if limit is None else out.limit(limit)
