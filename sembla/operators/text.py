"""Text descriptors: words, stems, vocabularies, weights and sparse similarity."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from sembla.session import ship_package


class Porter:
    """The published suffix-stripping algorithm of 1980 for lower-case English words."""

    # The suffix tables of the published algorithm.
    STEP2 = {"ational": "ate", "tional": "tion", "enci": "ence", "anci": "ance", "izer": "ize", "abli": "able", "alli": "al", "entli": "ent", "eli": "e", "ousli": "ous", "ization": "ize", "ation": "ate", "ator": "ate", "alism": "al", "iveness": "ive", "fulness": "ful", "ousness": "ous", "aliti": "al", "iviti": "ive", "biliti": "ble"}
    STEP3 = {"icate": "ic", "ative": "", "alize": "al", "iciti": "ic", "ical": "ic", "ful": "", "ness": ""}
    STEP4 = ("al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent", "ion", "ou", "ism", "ate", "iti", "ous", "ive", "ize")

    @staticmethod
    def _form(word: str) -> str:
        """The word as letters c and v."""
        out = ""
        for i, ch in enumerate(word):
            out += "v" if ch in "aeiou" or (ch == "y" and i > 0 and out[-1] == "c") else "c"
        return out

    def measure(self, stem: str) -> int:
        """How often a vowel run is followed by a consonant run."""
        return len(re.findall("v+c+", self._form(stem)))

    def _short(self, stem: str) -> bool:
        return self._form(stem)[-3:] == "cvc" and stem[-1] not in "wxy"

    def _double(self, stem: str) -> bool:
        return len(stem) > 1 and stem[-1] == stem[-2] and self._form(stem)[-1] == "c"

    def __call__(self, word: str) -> str:
        if len(word) < 3:
            return word
        w = word
        if w.endswith("sses") or w.endswith("ies"):
            w = w[:-2]
        elif w.endswith("s") and not w.endswith("ss"):
            w = w[:-1]
        if w.endswith("eed"):
            if self.measure(w[:-3]) > 0:
                w = w[:-1]
        else:
            for suffix in ("ed", "ing"):
                if w.endswith(suffix) and "v" in self._form(w[: -len(suffix)]):
                    w = w[: -len(suffix)]
                    if w.endswith(("at", "bl", "iz")):
                        w += "e"
                    elif self._double(w) and w[-1] not in "lsz":
                        w = w[:-1]
                    elif self.measure(w) == 1 and self._short(w):
                        w += "e"
                    break
        if w.endswith("y") and "v" in self._form(w[:-1]):
            w = w[:-1] + "i"
        for table in (self.STEP2, self.STEP3):
            for suffix in sorted(table, key=len, reverse=True):
                if w.endswith(suffix):
                    if self.measure(w[: -len(suffix)]) > 0:
                        w = w[: -len(suffix)] + table[suffix]
                    break
        for suffix in sorted(self.STEP4, key=len, reverse=True):
            if w.endswith(suffix):
                stem = w[: -len(suffix)]
                if self.measure(stem) > 1 and (suffix != "ion" or stem.endswith(("s", "t"))):
                    w = stem
                break
        if w.endswith("e"):
            m = self.measure(w[:-1])
            if m > 1 or (m == 1 and not self._short(w[:-1])):
                w = w[:-1]
        if w.endswith("ll") and self.measure(w[:-1]) > 1:
            w = w[:-1]
        return w


def words(text: Column) -> Column:
    """Lower-cased runs of ASCII letters, digits and underscores; an empty list for a null text."""
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit("([a-z0-9_]+)"), F.lit(1))


def stems(word_list: Column) -> Column:
    """Each word of the list by its stem."""
    ship_package()

    @F.pandas_udf("array<string>")
    def run(lists):
        stem, known = Porter(), {}

        def one(w: str | None) -> str | None:
            if w is not None and w not in known:
                known[w] = stem(w)
            return known.get(w)

        return lists.map(lambda row: None if row is None else [one(w) for w in row])

    return run(word_list)


def terms(docs: DataFrame, key: str, text: str, stem: bool = False) -> DataFrame:
    """key, word, f: how often each word stands in each text."""
    listed = words(F.col(text))
    rows = docs.select(key, F.explode(stems(listed) if stem else listed).alias("word"))
    return rows.groupBy(key, "word").agg(F.count(F.lit(1)).alias("f"))


def vocabulary(term_rows: DataFrame, key: str, documents: int, keep_all: bool = False) -> DataFrame:
    """word, df: documents that hold it; words that all documents hold are left out unless keep_all."""
    out = term_rows.groupBy("word").agg(F.count(F.lit(1)).alias("df"))
    return out if keep_all else out.where(F.col("df") < documents)


def tfidf(term_rows: DataFrame, vocab: DataFrame, key: str, documents: int) -> DataFrame:
    """key, word, weight: share of the word in its document times ln(documents / df), scaled to norm 1 per document."""
    length = term_rows.groupBy(key).agg(F.sum("f").alias("n"))
    raw = term_rows.join(vocab, "word").join(length, key).select(key, "word", (F.col("f") / F.col("n") * F.log(F.lit(float(documents)) / F.col("df"))).alias("w"))
    norm = raw.groupBy(key).agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))
    return raw.join(norm, key).where(F.col("norm") > 0).select(key, "word", (F.col("w") / F.col("norm")).alias("weight"))


def sparse_knn(weights: DataFrame, key: str, queries: DataFrame, k: int, block: int = 2000, metric: str = "cosine", unrelated: bool = False) -> DataFrame:
    """The k nearest documents of each query by cosine distance sqrt(2 (1 - dot)), or by L1; without unrelated only those that share a word.

    queries: key of the query set. Its vectors are held in blocks of at most
    ``block`` documents as inverted lists; the documents stream past, each as one
    row of its words, and no pairs are shuffled but a task's best ones (see against for
    more than one block). The query itself is left out. Dot products are rounded to 9
    decimals, so that ties of equal documents don't depend on the order of summation.
    Rows (query_id, rank, ref_id, distance).

    unrelated, for L1 only: the nearest are looked for among all documents. One that shares
    no word is as far as both masses (sums of weights) together. Documents without any
    weight have no vector and are left out.
    """
    from sembla.operators.search import against

    if metric not in ("cosine", "L1"):
        raise ValueError(f"unknown metric {metric}")
    if unrelated and metric != "L1":
        raise ValueError("all documents are ranked by L1 only")
    packed = weights.groupBy(F.col(key).cast("long").alias("id")).agg(F.collect_list(F.struct("word", "weight")).alias("v"))
    asked = weights.join(queries.select(key).distinct(), key, "left_semi").groupBy(F.col(key).cast("long").alias("id")).agg(F.collect_list(F.struct("word", "weight")).alias("v"))
    found = against(asked, packed, _sparse_scan(k, metric, unrelated), "query_id long, ref_id long, distance double", block, _inverted)
    rank = F.row_number().over(W.partitionBy("query_id").orderBy("distance", "ref_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "ref_id", "distance")


@dataclass
class _Lists:
    """Inverted lists of a block of queries: for word i the entries ends[i] .. ends[i + 1] (query, weight)."""

    ids: np.ndarray
    mass: np.ndarray
    vocabulary: pa.Array
    ends: np.ndarray
    query: np.ndarray
    weight: np.ndarray


def _inverted(table: pa.Table) -> _Lists | None:
    if not table.num_rows:
        return None
    lists = table.column(1).combine_chunks()
    flat = lists.flatten()
    query = np.repeat(np.arange(table.num_rows), pc.list_value_length(lists).to_numpy())
    words_ = flat.field(0).dictionary_encode()
    weight, code = flat.field(1).to_numpy(), words_.indices.to_numpy()
    order = np.argsort(code, kind="stable")
    ends = np.concatenate([[0], np.cumsum(np.bincount(code, minlength=len(words_.dictionary)))])
    return _Lists(table.column(0).to_numpy(), np.bincount(query, np.abs(weight), table.num_rows), words_.dictionary, ends, query[order], weight[order])


def _sparse_scan(k: int, metric: str, unrelated: bool, tile: int = 256, most: int = 1_000_000) -> Callable:
    """The k nearest documents of every query of a block; documents are taken at most ``tile`` at a time, or as many as meet ``most`` entries."""

    def scan(lists: _Lists) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            ids, ends = lists.ids, lists.ends
            # the best so far: place of the query, distance, document
            best = np.zeros(0, np.int64), np.zeros(0), np.zeros(0, np.int64)
            limit = np.full(len(ids), np.inf)
            for batch in batches:
                refs, flat = batch.column(0).to_numpy(), batch.column(1).flatten()
                word = pc.index_in(flat.field(0), value_set=lists.vocabulary).fill_null(-1).to_numpy()
                x = flat.field(1).to_numpy()
                doc = np.repeat(np.arange(len(refs)), pc.list_value_length(batch.column(1)).to_numpy())
                own = np.bincount(doc, np.abs(x), len(refs))
                known = word >= 0
                word, x, doc = word[known], x[known], doc[known]
                size = ends[word + 1] - ends[word]
                load = np.concatenate([[0], np.cumsum(np.bincount(doc, size, len(refs)))])
                a = 0
                while a < len(refs):
                    z = min(a + tile, max(a + 1, int(np.searchsorted(load, load[a] + most, "right")) - 1), len(refs))
                    low, high = np.searchsorted(doc, [a, z])
                    n = size[low:high]
                    entry = np.arange(n.sum()) + np.repeat(ends[word[low:high]] - np.cumsum(n) + n, n)
                    w, y = lists.weight[entry], np.repeat(x[low:high], n)
                    cell = lists.query[entry] * (z - a) + np.repeat(doc[low:high] - a, n)
                    cells = len(ids) * (z - a)
                    if metric == "cosine":
                        d = np.sqrt(2 * np.abs(1 - np.round(np.bincount(cell, w * y, cells), 9)))
                    else:
                        # what a shared word adds to the sum of both masses
                        extra = np.bincount(cell, np.abs(w - y) - np.abs(w) - np.abs(y), cells)
                        d = np.round((lists.mass[:, None] + own[a:z]).ravel() + extra, 9)
                    d = d.reshape(len(ids), z - a)
                    good = (d <= limit[:, None]) & (ids[:, None] != refs[a:z])
                    if not unrelated:
                        good &= np.bincount(cell, minlength=cells).reshape(d.shape) > 0
                    q, r = np.nonzero(good)
                    q, d, r = (np.concatenate(c) for c in zip(best, (q, d[q, r], refs[a:z][r])))
                    order = np.lexsort((r, d, q))
                    q, d, r = q[order], d[order], r[order]
                    place = np.arange(len(q)) - np.searchsorted(q, q)
                    best = tuple(c[place < k] for c in (q, d, r))
                    limit[q[place == k - 1]] = d[place == k - 1]
                    a = z
            if len(best[0]):
                yield pa.RecordBatch.from_arrays([pa.array(ids[best[0]]), pa.array(best[2]), pa.array(best[1])], names=["query_id", "ref_id", "distance"])

        return run

    return scan


def segment_terms(lines: DataFrame, segments: DataFrame, key: str, width: float = 10.0) -> DataFrame:
    """file, num_segment, word, f: words of the text lines (file, start_second, end_second, words) that a segment overlaps."""
    from sembla.operators.intervals import overlap_join

    spans = segments.select(F.col(key), "num_segment", "start_second", "end_second")
    hits = overlap_join(spans, lines.select(F.col(key), F.col("start_second"), F.col("end_second"), "words"), [key], ("start_second", "end_second"), ("start_second", "end_second"), width)
    return hits.select(key, "num_segment", F.explode("words").alias("word")).groupBy(key, "num_segment", "word").agg(F.count(F.lit(1)).alias("f"))
