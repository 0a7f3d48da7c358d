"""Many queries at once over documents that aren't indexed: the best documents of each, equal to ``search.top(search.scores(…))``.

Joining queries with postings makes a row per query, word and document, and
queries that begin like documents hold the hottest words.  Here the documents
are cut into segments that keep, by word, only the postings of the queries'
words.  A segment answers all queries in one task, each from the beginnings
of its words' postings in order of their part of the score, as far as a
document can still be among the best.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkwell.functions import bm25, text
from inkwell.operators import search
from inkwell.storage import materialize

SEGMENT = 1 << 16  # documents of a segment at most
WORDS = 1 << 22  # words of queries in a segment, about
BYTES = 1 << 22  # of text that is cut into tokens at once, more only for a longer document
PROBE = 256  # postings of a word that are looked at before the limit is set

_NARROW = "".join(c for c in text.SEPARATORS if c < "\x80") + "\r\n"
_WIDE = [c.encode() for c in text.SEPARATORS if c >= "\x80"]
_TABLE = bytes(32 if chr(i) in _NARROW else i + 32 if 65 <= i <= 90 else i for i in range(256))

_SEGMENT = "n_docs bigint, total_len bigint, terms array<int>, counts array<int>, in_null array<int>, docs binary, tfs binary, ids binary, lens binary"
_FOUND = "asked bigint, doc_id bigint, score double"


def best(docs: DataFrame, queries: DataFrame, k: int = search.TOP) -> DataFrame:
    """``query_id, rank, doc_id, score`` of the best ``k`` documents of each query; ties go to the smaller doc id.

    ``docs`` has ``doc_id, body``, the ids being unique whole numbers;
    ``queries`` has ``query_id, query, mode``, under the rules of
    ``search.scores``.  Queries of the same words and mode are answered once.
    The different queries are brought to the driver and from there to every
    task; of the documents, only numbers per word of a query are.
    """
    spark = docs.sparkSession
    keyed = materialize(_keyed(queries), "queries")
    different = keyed.select("mode", "words").distinct().toArrow().to_pydict()
    asks = [(mode, words.split(" ")) for mode, words in zip(different["mode"], different["words"])]
    vocabulary = sorted({w for _, words in asks for w in words})
    given = spark.sparkContext.broadcast(vocabulary)
    segments = materialize(docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("body").alias("body"))
                           .mapInArrow(lambda batches: _segments(batches, given.value), _SEGMENT), "segments")

    totals = segments.agg(F.sum("n_docs").alias("n"), F.sum("total_len").alias("len")).first()
    each = segments.select(F.explode(F.arrays_zip("terms", "counts", "in_null")).alias("x")).select("x.*")
    df = each.groupBy("terms").agg((F.sum("counts") + F.max("in_null")).alias("df")).toArrow()
    dfs = np.zeros(len(vocabulary))
    dfs[df["terms"].to_numpy()] = df["df"].to_numpy()
    at = {w: i for i, w in enumerate(vocabulary)}
    numbered = [(mode, [(at[w], words.count(w)) for w in dict.fromkeys(words)]) for mode, words in asks]
    task = spark.sparkContext.broadcast((numbered, dfs, totals.n or 0, (totals.len or 0) / (totals.n or 1), k))
    found = segments.mapInArrow(lambda batches: _answers(batches, *task.value), _FOUND)

    asked = spark.createDataFrame([(i, mode, " ".join(words)) for i, (mode, words) in enumerate(asks)], "asked bigint, mode string, words string")
    ranked = search.top(found.withColumnRenamed("asked", "query_id"), k).withColumnRenamed("query_id", "asked")
    back = keyed.join(asked, ["mode", "words"]).select("query_id", "asked")
    return ranked.join(back, "asked").select("query_id", "rank", F.col("doc_id").cast(docs.schema["doc_id"].dataType).alias("doc_id"), "score")


def _keyed(queries: DataFrame) -> DataFrame:
    """``query_id, mode, words`` of the queries that have words, the words in order, so that queries of the same words are alike."""
    words, mode = text.query_words(F.col("query")), F.lower(F.trim("mode"))
    bad = F.coalesce(~mode.isin(*search.MODES), F.lit(True))
    checked = F.when(bad, F.raise_error(F.lit("unknown mode")).cast("string")).when(
        F.size(words) > search.MOST_WORDS, F.raise_error(F.lit(f"a query has at most {search.MOST_WORDS} words")).cast("string")).otherwise(mode)
    return queries.where(F.size(words) > 0).select("query_id", checked.alias("mode"), F.array_join(F.array_sort(words), " ").alias("words"))


# -- segments ----------------------------------------------------------------------------------------------------


def _matches(body: pa.Array, vocabulary: pa.Array, short: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Which text and which word of the vocabulary each matching token is of, and the texts' lengths in tokens.

    Tokens as ``text.document_tokens`` cuts them, compared in lower case.
    """
    body = pc.fill_null(body.cast(pa.string()), "")
    offsets = np.frombuffer(body.buffers()[1], np.int32)[body.offset:body.offset + len(body) + 1].astype(np.int64)
    if offsets[0] == offsets[-1]:
        none = np.zeros(0, np.int32)
        return none, none, np.zeros(len(body), np.int32)
    data = bytes(memoryview(body.buffers()[2])[offsets[0]:offsets[-1]])
    offsets -= offsets[0]
    for wide in _WIDE:
        data = data.replace(wide, b"   ")
    data = data.translate(_TABLE)  # separators are spaces, ASCII is lower case, every byte in its place
    raw = np.frombuffer(data, np.uint8)
    inked = np.zeros(len(raw) + 2, bool)
    np.not_equal(raw, 32, out=inked[1:-1])
    starts, ends = inked[1:] & ~inked[:-1], inked[:-1] & ~inked[1:]
    inner = offsets[(offsets > 0) & (offsets < len(raw))]
    inner = inner[inked[inner] & inked[inner + 1]]  # texts that follow each other without a space
    starts[inner] = ends[inner] = True
    starts, ends = np.flatnonzero(starts), np.flatnonzero(ends)
    of = np.searchsorted(offsets, starts, "right") - 1
    lengths = np.bincount(of, minlength=len(body))

    bounds = np.empty(2 * len(starts), np.int32)  # tokens, and between them what parts them
    bounds[0::2], bounds[1::2] = starts, ends
    if not len(bounds):
        return of.astype(np.int32), of.astype(np.int32), lengths.astype(np.int32)
    values = pa.StringArray.from_buffers(len(bounds) - 1, pa.py_buffer(bounds), pa.py_buffer(data))
    word = pc.fill_null(pc.index_in(values, value_set=vocabulary), -1).to_numpy(zero_copy_only=False)[0::2].astype(np.int64)
    word[(word >= 0) & ~short[word]] = -1
    high = np.zeros(len(raw) + 1, np.int32)
    np.cumsum(raw >= 128, out=high[1:])
    other = np.flatnonzero((word < 0) & (high[ends] > high[starts]))  # maybe capitals beyond ASCII
    if len(other):
        coded = values.take(pa.array(2 * other)).cast(pa.binary()).dictionary_encode()
        forms = [b.decode(errors="replace") for b in coded.dictionary.to_pylist()]
        low = pc.fill_null(pc.index_in(pa.array([f.lower() for f in forms], pa.string()), value_set=vocabulary), -1).to_numpy(zero_copy_only=False).astype(np.int64)
        low[[i for i, f in enumerate(forms) if len(f) > text.MAX_TOKEN]] = -1
        word[other] = low[coded.indices.to_numpy(zero_copy_only=False)]
    hit = word >= 0
    return of[hit].astype(np.int32), word[hit].astype(np.int32), lengths.astype(np.int32)


def _segments(batches: Iterator[pa.RecordBatch], words: list[str]) -> Iterator[pa.RecordBatch]:
    """A row per segment of the batches' documents."""
    vocabulary, short = pa.array(words, pa.string()), np.array([len(w) <= text.MAX_TOKEN for w in words], bool)
    held, n_docs, n_words = [], 0, 0
    for batch in batches:
        for part in _parts(batch):
            if held and n_docs + part.num_rows > SEGMENT:
                yield _segment(held)
                held, n_docs, n_words = [], 0, 0
            of, word, lengths = _matches(part.column("body"), vocabulary, short)
            held.append((part.column("doc_id"), of + np.int32(n_docs), word, lengths))
            n_docs, n_words = n_docs + part.num_rows, n_words + len(word)
            if n_words >= WORDS:
                yield _segment(held)
                held, n_docs, n_words = [], 0, 0
    if held:
        yield _segment(held)


def _parts(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """The batch in parts of few documents and bytes."""
    upto = np.cumsum(pc.fill_null(pc.binary_length(batch.column("body")), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    start = 0
    while start < batch.num_rows:
        most = upto.searchsorted(BYTES + (upto[start - 1] if start else 0), "right")
        end = int(max(start + 1, min(start + SEGMENT, most)))
        yield batch.slice(start, end - start)
        start = end


def _segment(held: list) -> pa.RecordBatch:
    ids = pa.chunked_array([h[0] for h in held], pa.int64())
    of, word, lens = (np.concatenate([h[i] for h in held]) for i in (1, 2, 3))
    n = len(lens)
    pairs, tfs = np.unique(word.astype(np.int64) * n + of, return_counts=True)  # by word, then by document
    word, of = np.divmod(pairs, n)
    null = pc.is_null(ids).to_numpy()
    of_null = null[of]
    terms = np.unique(word)
    counts = np.bincount(np.searchsorted(terms, word[~of_null]), minlength=len(terms))
    in_null = np.isin(terms, word[of_null])  # postings without doc id count as one, and are never found
    of, tfs = of[~of_null], tfs[~of_null]
    raw = lambda a, kind: np.ascontiguousarray(a, kind).tobytes()
    listed = lambda a: pa.array([np.asarray(a, np.int32)], pa.list_(pa.int32()))
    return pa.RecordBatch.from_arrays(
        [pa.array([n]), pa.array([int(lens.sum(dtype=np.int64))]), listed(terms), listed(counts), listed(in_null),
         *(pa.array([b], pa.binary()) for b in (raw(of, "<i4"), raw(tfs, "<i4"), raw(pc.fill_null(ids, 0).to_numpy(), "<i8"), raw(lens, "<i4")))],
        ["n_docs", "total_len", "terms", "counts", "in_null", "docs", "tfs", "ids", "lens"])


# -- answers -----------------------------------------------------------------------------------------------------


def _rounded(x: np.ndarray) -> np.ndarray:
    """To the digits of a score, halves away from zero."""
    unit = 10.0 ** search.DIGITS
    y = np.abs(x) * unit
    low = np.floor(y)
    return np.copysign(low + (y - low >= 0.5), x) / unit + 0.0


#: What rounding and the last bits of sums can make of a score.
_SLACK = 2 * 10.0 ** -search.DIGITS


class _Postings:
    """A segment's postings by word: documents in order with their parts of the score, and the parts in descending order."""

    def __init__(self, row: dict, dfs: np.ndarray, n_docs: int, avg_len: float):
        self.ids, lens = np.frombuffer(row["ids"], "<i8"), np.frombuffer(row["lens"], "<i4")
        self.docs, tfs = np.frombuffer(row["docs"], "<i4"), np.frombuffer(row["tfs"], "<i4")
        terms, counts = np.array(row["terms"], np.int64), np.array(row["counts"], np.int64)
        ends = np.cumsum(counts)
        self.of = {t: (e - c, e) for t, c, e in zip(terms.tolist(), counts.tolist(), ends.tolist()) if c}
        word = np.repeat(terms, counts)
        idf = np.log((n_docs - dfs + 0.5) / (dfs + 0.5))[word]
        k = bm25.K1 * ((1 - bm25.B) + bm25.B * lens / avg_len) if avg_len else np.zeros(len(lens))
        self.part = idf * ((bm25.K1 + 1) * tfs / (k[self.docs] + tfs))
        order = np.lexsort((-self.part, word))
        self.falling, self.falling_docs = self.part[order], self.docs[order]
        self.negative = -self.falling

    def first(self, lo: int, hi: int, least: float) -> int:
        """How many parts of a word are at least ``least``."""
        return int(self.negative[lo:hi].searchsorted(-least, "right"))

    def parts(self, lo: int, hi: int, docs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The word's parts in these documents (0 where it isn't) and where it is."""
        own = self.docs[lo:hi]
        at = np.minimum(own.searchsorted(docs), hi - lo - 1)
        there = own[at] == docs
        return np.where(there, self.part[lo:hi][at], 0.0), there


def _candidates(p: _Postings, terms: list, whole: bool, limit: float, most: int | None = None) -> tuple[np.ndarray, int]:
    """Documents that may score ``limit`` or more, and of how many postings they are; at most ``most`` of a word.

    terms: first and last posting and times of each word.  What a document
    has of one word must reach the limit with the most of the others.
    """
    tops = [p.falling[lo] * times for lo, _, times in terms]
    if not whole:
        tops = [max(0.0, t) for t in tops]
    total = sum(tops)
    if total < limit:
        return p.docs[:0], 0
    reach = [p.first(lo, hi, (limit - (total - top)) / times) for (lo, hi, times), top in zip(terms, tops)]
    if whole:  # in all of the words, so also in the one with the fewest
        chosen = [min(range(len(terms)), key=reach.__getitem__)]
    else:  # in a word beside those whose most, together, doesn't reach the limit; long lists are left out first
        chosen, rest = [], 0.0
        for i in sorted(range(len(terms)), key=reach.__getitem__, reverse=True):
            if rest + tops[i] < limit:
                rest += tops[i]
            else:
                chosen.append(i)
    lists = [p.falling_docs[terms[i][0]:terms[i][0] + min(reach[i], most or reach[i])] for i in chosen]
    return np.unique(np.concatenate(lists)), sum(reach[i] for i in chosen)


def _score(p: _Postings, terms: list, whole: bool, docs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Those of the documents that match, and their scores, not yet rounded."""
    total, found = np.zeros(len(docs)), np.ones(len(docs), bool)
    for lo, hi, times in terms:
        part, there = p.parts(lo, hi, docs)
        total += part * times
        found &= there
    return (docs[found], total[found]) if whole else (docs, total)


def _answer(p: _Postings, terms: list, whole: bool, k: int, known: tuple | None) -> tuple | None:
    """The best ``k`` of what is known (rounded scores and doc ids, best first) and of this segment."""
    limit = known[0][-1] - _SLACK if known and len(known[0]) == k else -np.inf
    if not whole:  # k documents have at least this
        worst = [min(0.0, p.falling[hi - 1] * times) for lo, hi, times in terms]
        limit = max([limit, *(p.falling[lo + k - 1] * times + sum(worst) - w - _SLACK for (lo, hi, times), w in zip(terms, worst) if hi - lo >= k)])
    docs, n = _candidates(p, terms, whole, limit, PROBE)
    if n > PROBE:
        _, scores = _score(p, terms, whole, docs)
        if len(scores) >= k:
            limit = max(limit, np.partition(scores, -k)[-k] - _SLACK)
        docs, _ = _candidates(p, terms, whole, limit)
    if not len(docs):
        return known
    docs, scores = _score(p, terms, whole, docs)
    keep = scores >= limit
    scores, ids = _rounded(scores[keep]), p.ids[docs[keep]]
    if known:
        scores, ids = np.concatenate([known[0], scores]), np.concatenate([known[1], ids])
    order = np.lexsort((ids, -scores))[:k]
    return (scores[order], ids[order]) if len(order) else None


def _answers(batches: Iterator[pa.RecordBatch], asks: list, dfs: np.ndarray, n_docs: int, avg_len: float, k: int) -> Iterator[pa.RecordBatch]:
    """The best documents of each query in the batches' segments."""
    known: dict[int, tuple] = {}
    for batch in batches:
        for i in range(batch.num_rows):
            p = _Postings(batch.slice(i, 1).to_pylist()[0], dfs, n_docs, avg_len)
            for number, (mode, words) in enumerate(asks):
                terms = [(*p.of[w], times) for w, times in words if w in p.of]
                whole = mode == "c"
                if terms and not (whole and len(terms) < len(words)) and (now := _answer(p, terms, whole, k, known.get(number))):
                    known[number] = now
    for start in range(0, len(known), 4096):
        part = [*known.items()][start:start + 4096]
        numbers = np.repeat([n for n, _ in part], [len(s) for _, (s, _) in part])
        yield pa.RecordBatch.from_arrays([pa.array(numbers, pa.int64()), pa.array(np.concatenate([d for _, (_, d) in part])), pa.array(np.concatenate([s for _, (s, _) in part]))],
                                         ["asked", "doc_id", "score"])
