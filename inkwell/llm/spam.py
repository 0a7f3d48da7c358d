"""Pages of repeated keywords, link lists or product tags instead of an article.

Page measures: shares of the most frequent words and of repeated word pairs,
of duplicate lines, of text in links and in product tags, density of
separators, and function words.  Menus don't count.  All limits are measured
per language over the ordinary pages, those of some sentences: a share is high
that lies clearly above what 99 of 100 of them have, and function words are
missing that lie far below what nine of ten have.  A page is spam if it has
hardly any function words, at most one ordinary sentence, and one of the other
shares is high.

A page is looked at as a whole.  Pages of more than ``PART`` lines are looked
at in parts (``long_pages``), with the same result.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkwell.llm import layout, lexicon, long_pages
from inkwell.storage import materialize

STRETCH = 40  # words among which repeats tell stuffed text
REPEATED = 5  # pages of a site on which a line is the site's and not a page's
PART = 4096  # lines of a long page that are looked at in one row
#: Of each share: the ordinary page that 99 of 100 stay below, where a collection has no ordinary pages to measure it on.
ORDINARY = {"top": 0.12, "pairs": 0.24, "links": 0.38, "tags": 0.0, "separators": 0.19, "lines": 0.2}
ABOVE, FAR = 0.1, 0.3  # how far from there to 1 a share is high, and so high that it needs no lack of function words
FUNCTION_PART = 0.4  # of the ordinary share of function words in the page's language
ORDINARY_SENTENCES = 3  # sentences of a page that ordinary shares are measured on

_WORD = re.compile(r"\w+")
_LINK = re.compile(r"https?://\S+|www\.\S+|\]\(")
_TAG = re.compile(r"^SKU \d|\d+[.,]\d\d$|\(\d+\)$|(#\w+ ?){2,}|^tags? ", re.IGNORECASE)
_SIGNS = "|,;#/·•-"


_END = re.compile(r"[.!?…]+(?=[\s\"'”“’»)\]]|$)")


@lru_cache(1)
def _function() -> tuple[frozenset[str], dict[str, list[str]]]:
    """All function words, and the languages of each."""
    langs: dict[str, list[str]] = {}
    for lang, words in lexicon.function_words().items():
        for w in words:
            langs.setdefault(w, []).append(lang)
    return frozenset(langs), langs


MEASURES = ["words", "sentences", "function", "top", "pairs", "links", "tags", "separators", "lines", "n_lines"]


def count(texts: list[str]) -> tuple[dict[str, int], Counter, Counter]:
    """What of a page's lines (or a part of them) can be added up: sums, and counts of words and of pairs of words within a line."""
    any_function, _ = _function()
    is_function = any_function.__contains__
    words: Counter[str] = Counter()
    pairs: Counter[tuple[str, str]] = Counter()
    sums = dict.fromkeys(SUMS, 0)
    for text in texts:
        low = text.lower()
        own = _WORD.findall(low)
        words.update(own)
        pairs.update(zip(own, own[1:]))
        n = len(own)
        sums["words"] += n
        if n > 4 and 10 * sum(map(is_function, own)) >= n:
            ends = len(_END.findall(text))
            if ends and _varied(own, ends):
                sums["sentences"] += ends
        if ("://" in text or "www." in low or "](" in text) and _LINK.search(text):
            sums["links"] += n
        elif (text[-1:] == ")" or text[-1:].isdigit() or "#" in text or low.startswith(("sku ", "tag"))) and _TAG.search(text):
            sums["tags"] += n
        sums["separators"] += sum(map(text.count, _SIGNS))
    sums["n_lines"] = len(texts)
    return sums, words, pairs


def languages(words: Counter) -> Counter:
    """Function words by language; one that several languages have counts for each."""
    any_function, of = _function()
    by_lang: Counter[str] = Counter()
    for w in any_function & words.keys():
        for lang in of[w]:
            by_lang[lang] += words[w]
    return by_lang


def is_content(word: str) -> bool:
    return len(word) > 2 and not word.isdigit() and word not in _function()[0]


def is_telling(pair: tuple[str, str]) -> bool:
    """Two function words after each other are no repetition."""
    any_function = _function()[0]
    return pair[0] not in any_function or pair[1] not in any_function


SUMS = ["words", "sentences", "links", "tags", "separators", "n_lines"]
MEASURES = ["words", "sentences", "function", "top", "pairs", "links", "tags", "separators", "lines", "n_lines"]


def measure(texts: list[str]) -> dict[str, int | str]:
    """Counts over a page's lines without its furniture; shares are these by ``words`` (``lines`` by ``n_lines``)."""
    sums, words, pairs = count(texts)
    by_lang = languages(words)
    lang = max(by_lang, key=lambda x: (by_lang[x], x)) if by_lang else ""
    return {"lang": lang, **sums, "function": by_lang[lang], "top": sum(sorted(n for w, n in words.items() if n > 2 and is_content(w))[-3:]),
            "pairs": sum(n - 1 for p, n in pairs.items() if n > 1 and is_telling(p)), "lines": len(texts) - len(set(texts))}


def _varied(own: list[str], ends: int) -> bool:
    """Whether words don't come again and again, as they do in stuffed text; long texts are looked at in stretches."""
    if ends == 1:
        return 3 * len(set(own)) >= 2 * len(own)
    return 2 * sum(len(set(own[i : i + STRETCH])) for i in range(0, len(own), STRETCH)) >= len(own)


_OPEN = pa.list_(pa.struct([("line_no", pa.int32()), ("key", pa.int64())]))
_SCHEMA = pa.schema([("doc_id", pa.int64()), ("lang", pa.string()), *[(m, pa.int64()) for m in MEASURES], ("hidden", pa.list_(pa.int32())),
                     ("keys", pa.list_(pa.int64())), ("open", _OPEN)])
LINES_DDL = "hidden array<int>, keys array<bigint>, open array<struct<line_no:int,key:bigint>>"
_DDL = "doc_id bigint, lang string, " + ", ".join(f"{m} bigint" for m in MEASURES) + ", " + LINES_DDL


def shown_and_hidden(body: layout.Element) -> tuple[list[str], list[int]]:
    """Texts of the visible lines of a page's tree, and the numbers of its hidden lines."""
    hidden, shown = [], []
    for e in body.children:
        if not layout.visible(e):
            hidden += [c.line_no for c in e.children]
        elif e.tag != "br":
            shown += [c.text for c in e.children] if e.tag in ("ul", "table") else [e.text]
    return shown, hidden


def once(numbers: list[int], lines: list[str | None]) -> list[tuple[int, str | None]]:
    """Lines in order; of a line delivered twice, the larger text."""
    if all(a < b for a, b in zip(numbers, numbers[1:])):
        return list(zip(numbers, lines, strict=True))
    own: dict[int, str | None] = {}
    for n, line in zip(numbers, lines, strict=True):
        if n not in own or (line or "") > (own[n] or ""):
            own[n] = line
    return sorted(own.items())


_DIGITS = re.compile("[0-9]+")


def line_key(flat: str) -> int:
    """64 bits of a flat line without regard to case and numbers: lines of one key count as the same."""
    return xxhash.xxh64_intdigest(_DIGITS.sub("0", flat.lower())) - (1 << 63)


def keys_and_open(flat: list[tuple[int, str]], hidden: list[int]) -> tuple[list[int], list[tuple[int, int]]]:
    """The different keys of some lines that aren't blank, and number and key of those that aren't hidden."""
    gone = set(hidden)
    keyed = [(n, line_key(x)) for n, x in flat if x]
    return list({k for _, k in keyed}), [x for x in keyed if x[0] not in gone]


class _Lists:
    """Lists of a batch's rows, kept flat: Arrow takes them far quicker than nested ones."""

    def __init__(self):
        self.flat, self.ends = [], [0]

    def add(self, values: list) -> None:
        self.flat += values
        self.ends.append(len(self.flat))

    def array(self, values: pa.Array) -> pa.Array:
        return pa.ListArray.from_arrays(pa.array(self.ends, pa.int32()), values)


def _pages(batch: pa.RecordBatch) -> Iterator[tuple]:
    """Rows of a batch whose columns from the second on are lists of one length; flat columns are far quicker to read than nested ones."""
    ends = np.cumsum(pc.fill_null(pc.list_value_length(batch.column(1)), 0).to_numpy(zero_copy_only=False)).tolist()
    flat = [batch.column(i).flatten().to_pylist() for i in (1, 2)]
    for doc_id, a, b in zip(batch.column(0).to_pylist(), [0, *ends], ends):
        yield doc_id, once(flat[0][a:b], flat[1][a:b])


def _look(with_lines: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            doc_ids, measures, hiddens, keys, opens = [], [], _Lists(), _Lists(), _Lists()
            for doc_id, page in _pages(batch):
                # boxes and prompts are furniture of ordinary pages; what is left decides
                if layout.is_markup(page):
                    shown, hidden = shown_and_hidden(layout.build(page))
                    flat = [(n, " ".join((x or "").split())) for n, x in page]
                else:
                    kinds, texts = known = layout.roles([x for _, x in page])
                    flat = [(n, x) for (n, _), x in zip(page, texts, strict=True)]
                    if with_lines:
                        shown, hidden = shown_and_hidden(layout.build(page, known))
                    else:  # what the tree would show
                        shown = [x for k, x in zip(kinds, texts, strict=True) if k is None]
                doc_ids.append(doc_id)
                measures.append(measure(shown))
                if with_lines:
                    own, open_ = keys_and_open(flat, hidden)
                    hiddens.add(hidden)
                    keys.add(own)
                    opens.add(open_)
            columns = [pa.array(doc_ids, pa.int64()), *[pa.array([m[c] for m in measures], _SCHEMA.field(c).type) for c in ("lang", *MEASURES)]]
            if with_lines:
                numbers, of = zip(*opens.flat) if opens.flat else ((), ())
                pairs = pa.StructArray.from_arrays([pa.array(numbers, pa.int32()), pa.array(of, pa.int64())], fields=list(_OPEN.value_type))
                columns += [hiddens.array(pa.array(hiddens.flat, pa.int32())), keys.array(pa.array(keys.flat, pa.int64())), opens.array(pairs)]
            else:
                columns += [pa.nulls(len(doc_ids), _SCHEMA.field(c).type) for c in ("hidden", "keys", "open")]
            yield pa.record_batch(columns, schema=_SCHEMA)

    return run


_TEXT = pa.schema([("doc_id", pa.int64()), ("text", pa.string())])


def _render(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        for doc_id, numbers, lines, gone in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
            gone = set(gone or ())
            page = [(n, None if n in gone else x) for n, x in once(numbers, lines)]
            rows.append({"doc_id": doc_id, "text": layout.render(layout.build(page))})
        yield pa.RecordBatch.from_pylist(rows, schema=_TEXT)


def _rows(trec_line: DataFrame) -> DataFrame:
    return trec_line.where("doc_id IS NOT NULL AND line_no IS NOT NULL").select("doc_id", "line_no", "line")


def looked_at(trec_line: DataFrame, part: int = PART, with_lines: bool = True) -> DataFrame:
    """A row per page: its measures, and ``with_lines`` the numbers of its hidden lines, the keys of all lines, and number and key of the others.

    Pages with line numbers outside of 1 … ``part`` and without markup are
    looked at in parts, each a row without measures, and have a row of
    measures without lines.
    """
    rows = _rows(trec_line)
    outside = materialize(rows.where((F.col("line_no") > part) | (F.col("line_no") < 1)).select("doc_id").distinct(), "long-pages")
    in_parts = None
    if not outside.isEmpty():
        marked = rows.join(outside, "doc_id", "left_semi").where(F.col("line").rlike(layout.MARKUP)).select("doc_id").distinct()
        long = materialize(outside.join(marked, "doc_id", "left_anti"), "long-pages")
        in_parts = long_pages.looked_at(rows.join(long, "doc_id", "left_semi"), part)
        rows = rows.join(long, "doc_id", "left_anti")
    pages = rows.groupBy("doc_id").agg(F.collect_list(F.struct("line_no", "line")).alias("lines"))
    whole = pages.select("doc_id", F.col("lines.line_no"), F.col("lines.line")).mapInArrow(_look(with_lines), _DDL)
    return whole if in_parts is None else whole.unionByName(in_parts)


def verdicts(pages: DataFrame) -> DataFrame:
    """``doc_id, lang, spam`` and the shares, from the rows of ``looked_at``.

    A page without words, or of nothing but furniture, is no spam.
    """
    share = lambda m: F.coalesce(F.try_divide(F.col(m), F.col("n_lines" if m == "lines" else "words")), F.lit(0.0)).alias(m)
    page = pages.where("lang IS NOT NULL").select("doc_id", "lang", "words", "sentences", share("function"), *[share(m) for m in ORDINARY])
    ordinary = page.where(F.col("sentences") >= ORDINARY_SENTENCES)
    quantiles = [F.percentile_approx("function", 0.1).alias("usual"), *[F.percentile_approx(m, 0.99).alias(f"{m}_most") for m in ORDINARY]]
    names = ["usual", *[f"{m}_most" for m in ORDINARY]]
    all_ = ordinary.agg(*[q.alias(f"{n}_all") for q, n in zip(quantiles, names, strict=True)])  # one row
    page = page.join(ordinary.groupBy("lang").agg(*quantiles), "lang", "left").crossJoin(F.broadcast(all_))
    fixed = {"usual": 0.25, **{f"{m}_most": x for m, x in ORDINARY.items()}}
    page = page.withColumns({n: F.coalesce(n, f"{n}_all", F.lit(fixed[n])) for n in names})
    few = F.col("function") < FUNCTION_PART * F.col("usual")
    limit = lambda m, x: F.col(f"{m}_most") + x * (1 - F.col(f"{m}_most"))
    high = {m: F.col(m) >= limit(m, ABOVE) for m in ORDINARY}
    # separators alone are also what is left of a page whose characters were lost
    high["separators"] &= F.col("top") >= limit("top", ABOVE) / 2
    any_high = F.lit(False)
    for h in high.values():
        any_high = any_high | h
    # a product's name can hold function words; what repeats this much without a sentence is no article either
    stuffed = (F.col("sentences") == 0) & ((F.col("top") >= limit("top", FAR)) | (F.col("pairs") >= limit("pairs", FAR)))
    spam = ((few & any_high) | stuffed) & (F.col("sentences") <= 1) & (F.col("words") > 0)
    return page.select("doc_id", "lang", "words", "sentences", F.round("function", 4).alias("function"), "usual",
                       *[F.round(m, 4).alias(m) for m in ORDINARY], *[F.round(limit(m, ABOVE), 4).alias(f"{m}_limit") for m in ORDINARY], spam.alias("spam"))


def spam_pages(trec_line: DataFrame) -> DataFrame:
    """``doc_id`` of pages without an article.

    Rows without page or line number are left out, a line delivered twice is
    one line, of two that differ the larger text counts; a page of null and
    blank lines is no spam, and an empty table gives no rows.
    """
    return verdicts(materialize(looked_at(trec_line, with_lines=False).drop("hidden", "keys", "open"), "pages")).where("spam").select("doc_id")


def repeated(pages: DataFrame, sites: DataFrame, least: int = REPEATED) -> DataFrame:
    """``doc_id, line_no`` of lines that aren't hidden, but stand on at least ``least`` pages of their site.

    ``pages`` are rows of ``looked_at``, ``sites`` has ``doc_id, site``; pages
    without a site have none.  Keys are counted once per page (once per part
    of a long one) and folded in the task before the exchange.
    """
    placed = pages.where("keys IS NOT NULL").select("doc_id", "keys", "open").join(sites.where("site IS NOT NULL").select("doc_id", F.xxhash64("site").alias("site")), "doc_id")
    counted = placed.select("site", F.explode("keys").alias("key")).groupBy("site", "key").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least)
    lines = placed.select("doc_id", "site", F.explode("open").alias("x")).select("doc_id", "site", "x.line_no", "x.key")
    return lines.join(counted.select("site", "key"), ["site", "key"], "left_semi").select("doc_id", "line_no")


def furniture(trec_line: DataFrame, sites: DataFrame | None = None) -> DataFrame:
    """``doc_id, line_no`` of lines that are not the article, on pages that have one, each once.

    With ``sites`` (``doc_id, site``), lines that a site repeats from page to
    page are furniture whatever they say.  Null and blank lines are in no row,
    nor are rows without page or line number.  An empty table gives no rows;
    lines of any length are looked at whole.
    """
    pages = materialize(looked_at(trec_line), "pages")
    spam = verdicts(pages).where("spam").select("doc_id")
    found = pages.where("hidden IS NOT NULL").select("doc_id", F.explode("hidden").alias("line_no"))
    if sites is not None:
        found = found.unionByName(repeated(pages, sites))
    return found.join(spam, "doc_id", "left_anti")


def main_texts(trec_line: DataFrame, sites: DataFrame | None = None) -> DataFrame:
    """``doc_id, text``: the rendered article of every page that has one, a row per page, which therefore holds all of its lines.

    A page whose article is empty has an empty text.
    """
    pages = materialize(looked_at(trec_line), "pages")
    spam = verdicts(pages).where("spam").select("doc_id")
    lines = _rows(trec_line).groupBy("doc_id").agg(F.collect_list(F.struct("line_no", "line")).alias("lines")).join(spam, "doc_id", "left_anti")
    gone = F.lit(None).cast("array<int>").alias("gone")
    if sites is not None:
        lines = lines.join(repeated(pages, sites).groupBy("doc_id").agg(F.collect_list("line_no").alias("gone")), "doc_id", "left")
        gone = F.col("gone")
    return lines.select("doc_id", F.col("lines.line_no"), F.col("lines.line"), gone).mapInArrow(_render, "doc_id bigint, text string")
