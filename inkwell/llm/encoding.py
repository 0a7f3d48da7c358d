"""Text decoded with a wrong character encoding: finding it and giving it back.

1. *Near-twins.*  Words and lines are grouped by what is left without their
   non-ASCII characters.  The form that most rows have is the clean twin of
   the rarer forms; only (form, twin) pairs are joined, never all forms.
2. *Learning.*  Aligned at their common ASCII characters, a pair leaves gaps,
   and each character of the gaps becomes a learned mapping (garbled, clean).
   Every hypothesis "encoded as X, read as Y" that turns the clean gaps into
   the garbled ones gets the pair as support, and its mappings.  Mappings that
   many pairs agree in and no hypothesis explains are a transformation of
   their own.
3. *Applying.*  On all lines, the transformations are undone word by word: by
   their learned mappings, and by the encoding where no pair showed a
   character.  The best run of words decides.  How much more usual the text
   becomes is measured by a character model counted over all lines.

U+FFFD marks text that can't be given back by a mapping; such words are taken
from their clean twin where there is one.
"""

from __future__ import annotations

import copy
import math
import re
import unicodedata
import uuid
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkwell.storage import materialize

#: Encodings that texts are kept in, and those that they are wrongly read as.
SOURCES = ["cp1252", "cp1250", "iso8859_2", "cp1251", "koi8_r", "cp866", "cp850", "cp852", "cp437", "mac_roman"]
READ_AS = ["cp1252", "latin_1", "cp1250", "iso8859_2", "cp1251", "koi8_r", "cp437", "cp850", "cp852", "cp866", "mac_roman",
           "iso8859_5", "iso8859_15", "mac_cyrillic", "cp1254", "cp1253", "cp1257"]

MIN_SUPPORT = 2  # different pairs that a transformation must explain to count as learned
TWIN_ROWS = 3  # rows that a twin must have, and times those of the garbled form
OWN_PAIRS, AGREEING, OF_ALL = 3, 0.9, 0.5  # a mapping that no encoding explains: pairs, part of them that agree, and of the character's occurrences
#: Least gain in log-likelihood (natural: 7 is odds of 1,000 to 1 for the text before) of a multi-byte and a single-byte transformation, learned
#: and not, and on a page or with characters that are surely garbled.  The fewer texts could come out by chance, the less is asked for: multi-byte
#: sequences hardly ever decode by chance, single bytes always do, and a page that was read in one wrong way was so throughout.
GAIN = {"wide": 1.0, "wide_unlearned": 8.0, "single": 7.0, "single_unlearned": 16.0, "wide_page": 0.3, "single_page": 1.5, "marked": 1.0}
CHANCE = 7.0  # added per word that a multi-byte transformation takes back: other words hardly ever decode
UNLEARNED_CHARACTERS = 3  # different characters of a word that show a single-byte transformation without learned pairs
RARER = 0.05  # a character isn't taken back to one that occurs so many times less often
BESIDE = 6.0  # loss of a word beside a garbled run up to which it is taken to belong to it
MARKER = 0.93  # a character of which so large a part stands in surely garbled lines marks others

REPLACED = "�"
SPACE = "\u00a0"  # not at which words are split: it can be part of a garbled character
_OUTSIDE = re.compile("[^\x00-\x7f]")
_OUTSIDE_RUN = re.compile("[^\x00-\x7f]+")
_LETTERS = re.compile("[A-Za-z]")

UNI, BI, TRI = 1 << 16, 1 << 18, 1 << 20  # slots of the model's count tables; their size doesn't depend on the data


def _table(codec: str) -> list[str]:
    """What each byte is read as; a byte without a character becomes the control character of its number."""
    return [bytes([b]).decode(codec, "ignore") or chr(b) for b in range(256)]


class Transformation:
    """Text kept in one encoding and read in another, once or twice; ``undo`` goes back."""

    def __init__(self, source: str, read_as: str, times: int = 1):
        self.name = f"{source}>{read_as}" + (f"x{times}" if times > 1 else "")
        self.source, self.read_as, self.times = source, read_as, times
        self.wide = source == "utf_8"
        table = _table(read_as)
        self._byte = {c: b for b, c in reversed(list(enumerate(table))) if b > 127}
        own = None if self.wide else _table(source)
        self._char = own
        #: characters that garbled text of this kind can hold
        self.domain = frozenset(c for c, b in self._byte.items() if self.wide or own[b] != c)
        self.mappings: dict[str, str] = {}  # garbled → clean, as pairs showed them

    def undo(self, text: str) -> str | None:
        """The text before, or None if it can't have come about this way: by the learned mappings, where they don't reach by the encoding."""
        if self.mappings and (before := _mapped(text, self.mappings)) is not None:
            return before
        for _ in range(self.times):
            data = bytearray()
            for c in text:
                b = ord(c)
                if b > 127:
                    b = self._byte.get(c)
                    if b is None:
                        return None
                data.append(b)
            if self.wide:
                try:
                    before = data.decode("utf-8")
                except UnicodeDecodeError:
                    return None
                if len(before) == len(text):
                    return None
                text = before
            else:
                text = "".join(chr(b) if b < 128 else self._char[b] for b in data)
        return text


def _mapped(text: str, mappings: dict[str, str]) -> str | None:
    """Every run of characters outside ASCII replaced by what its parts of one width map to; None if one has no mapping."""
    out, upto = [], 0
    for m in _OUTSIDE_RUN.finditer(text):
        run = m[0]
        for width in range(1, min(len(run), 8) + 1):
            if len(run) % width == 0:
                parts = [mappings.get(run[i : i + width]) for i in range(0, len(run), width)]
                if None not in parts:
                    break
        else:
            return None
        out += [text[upto : m.start()], *parts]
        upto = m.end()
    return "".join(out) + text[upto:]


class OwnMapping:
    """A transformation that no listed encoding explains: nothing but learned mappings of one width."""

    def __init__(self, width: int, mappings: dict[str, str]):
        self.name, self.wide, self.times, self.mappings = f"learned>{width}", width > 1, 1, mappings
        self._byte: dict[str, int] = {}
        self.domain = frozenset("".join(mappings))

    def undo(self, text: str) -> str | None:
        return _mapped(text, self.mappings)


@lru_cache(1)
def hypotheses() -> dict[str, Transformation]:
    """All transformations of the listed encodings that change something, by name."""
    made = [Transformation("utf_8", y) for y in READ_AS]
    made += [Transformation("utf_8", y, 2) for y in READ_AS[:2] + ["cp437", "cp850", "mac_roman", "cp1251"]]
    made += [t for x in SOURCES for y in READ_AS if x != y and (t := Transformation(x, y)).domain]
    return {t.name: t for t in made}


def skeleton(text: str) -> str:
    """The ASCII part of a text."""
    return _OUTSIDE_RUN.sub("", text)


# -- the character model ---------------------------------------------------------------------------------------


def _slots(a, b, c):
    """Slots of the pair (b, c) and the triple (a, b, c); for numbers and arrays alike."""
    mix = 0x9E3779B97F4A7C15
    if isinstance(a, np.ndarray):
        pair = ((b << np.uint64(21) | c) * np.uint64(mix)) >> np.uint64(46)
        triple = ((a << np.uint64(42) | b << np.uint64(21) | c) * np.uint64(mix)) >> np.uint64(44)
        return pair.astype(np.int64) + UNI, triple.astype(np.int64) + UNI + BI
    low = (1 << 64) - 1
    pair = ((b << 21 | c) * mix & low) >> 46
    return UNI + pair, UNI + BI + (((a << 42 | b << 21 | c) * mix & low) >> 44)


_STATISTICS = "slot int, skeleton string, form string, n bigint"


def _statistics(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts of characters, pairs and triples by slot, and of forms: words with two ASCII letters, lines mostly of other letters."""
    total = np.zeros(UNI + BI + TRI, dtype=np.int64)
    forms: Counter[str] = Counter()
    held = 0
    for batch in batches:
        lines = batch.column(0).to_pylist()
        text = "  ".join(["", *lines, ""])
        codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.uint64)
        a, b, c = codes[:-2], codes[1:-1], codes[2:]
        total[:UNI] += np.bincount((b & np.uint64(UNI - 1)).astype(np.int64), minlength=UNI)
        pair, triple = _slots(a, b, c)
        near = (a > 127) | (b > 127) | (c > 127)
        total += np.bincount(pair, minlength=total.size)
        total += np.bincount(triple[near], minlength=total.size)
        for line in lines:
            forms.update([w for w in line.split(" ") if not w.isascii()])
            other = len(line.encode()) - len(line)
            if 2 * other > len(line) - line.count(" "):
                forms[line] += 1
            held += len(line)
        if len(forms) > 200_000 or held > 64_000_000:  # what a task holds, whatever the lengths of words
            yield _forms(forms)
            forms.clear()
            held = 0
    yield _forms(forms)
    used = np.flatnonzero(total)
    none = pa.nulls(len(used), pa.string())
    yield pa.record_batch([pa.array(used.astype(np.int32)), none, none, pa.array(total[used])], names=["slot", "skeleton", "form", "n"])


def _forms(forms: Counter[str]) -> pa.RecordBatch:
    kept = [(k, f, n) for f, n in forms.items() if len(_LETTERS.findall(k := skeleton(f))) > 1]
    columns = list(zip(*kept)) or [[], [], []]
    return pa.record_batch([pa.nulls(len(kept), pa.int32()), *(pa.array(x, t) for x, t in zip(columns, (pa.string(), pa.string(), pa.int64())))],
                           names=["slot", "skeleton", "form", "n"])


def statistics(text: DataFrame) -> DataFrame:
    """``slot, skeleton, form, n``: both kinds of counts from one pass over the lines (``slot`` or ``form`` is null)."""
    counted = text.mapInArrow(_statistics, _STATISTICS).groupBy("slot", "skeleton", "form").agg(F.sum("n").alias("n"))
    return materialize(counted, "statistics")


def character_counts(counted: DataFrame) -> np.ndarray:
    """Counts of single characters, pairs and triples over all lines, in tables of fixed size (5 MB)."""
    rows = counted.where("slot IS NOT NULL").select("slot", "n").toArrow()
    counts = np.zeros(UNI + BI + TRI, dtype=np.float32)
    counts[rows["slot"].to_numpy()] = rows["n"].to_numpy()
    return counts


class CharacterModel:
    """Log-probability of words, of their parts near non-ASCII characters only."""

    STRENGTH = 3.0

    def __init__(self, counts: np.ndarray):
        self._n, self._total, self._known = counts, float(counts[:UNI].sum()) + 1, {}

    def _step(self, a: int, b: int, c: int) -> float:
        """log p(c | a, b), where a of 0 is unknown."""
        n, k = self._n, self.STRENGTH
        pair, triple = _slots(a, b, c)
        p = (n[c & (UNI - 1)] + 0.02) / self._total
        p = (n[pair] + k * p) / (n[b & (UNI - 1)] + k)
        if a:
            p = (n[triple] + k * p) / (n[_slots(0, a, b)[0]] + k)
        return math.log(p)

    def score(self, word: str) -> float:
        text = "\0 " + word + " "
        total, known = 0.0, self._known
        for i in range(3, len(text) + 1):
            key = text[i - 3 : i]
            if not key.isascii():
                step = known.get(key)
                if step is None:
                    step = known[key] = self._step(*map(ord, key))
                total += step
        return total


# -- learning from near-twins ----------------------------------------------------------------------------------


def twins(counted: DataFrame) -> DataFrame:
    """``skeleton, form, n, twin, n_twin``: every form with the most frequent form of its skeleton.

    Forms are counted before they meet, so a skeleton costs one row per form,
    however many lines have it; ties go to the larger text.
    """
    forms = counted.where("form IS NOT NULL").select("skeleton", "form", "n")
    top = forms.groupBy("skeleton").agg(F.max(F.struct("n", "form")).alias("t"))
    top = top.select("skeleton", F.col("t.form").alias("twin"), F.col("t.n").alias("n_twin"))
    return forms.join(top, "skeleton")


def _gaps(text: str) -> list[str]:
    return _OUTSIDE_RUN.findall(text)


def explain(form: str, twin: str) -> list[str]:
    """Names of the transformations that turn the gaps of ``twin`` into those of ``form``."""
    garbled, clean = _gaps(form), _gaps(twin)
    if len(garbled) != len(clean) or garbled == clean or REPLACED in form:
        return []
    longer = len(form) > len(twin)
    return [
        name for name, t in hypotheses().items()
        if t.wide == longer and all(t.undo(g) == c for g, c in zip(garbled, clean, strict=True))
    ]


_MAPPINGS = pa.schema([("names", pa.string()), ("garbled", pa.string()), ("clean", pa.string()), ("pairs", pa.int64()), ("rows", pa.int64())])


def _characters(form: str, twin: str) -> list[tuple[str, str]] | None:
    """The characters that a pair maps, if all of its gaps became longer by one factor."""
    garbled, clean = _gaps(form), _gaps(twin)
    if len(garbled) != len(clean) or garbled == clean or REPLACED in form:
        return None
    width = len(garbled[0]) // len(clean[0]) if garbled else 0
    if width < 1 or any(len(g) != width * len(c) for g, c in zip(garbled, clean, strict=True)):
        return None
    return [(g[i * width : (i + 1) * width], x) for g, c in zip(garbled, clean, strict=True) for i, x in enumerate(c)]


def _support(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found: dict[tuple[str, str | None, str | None], list[int]] = {}
        for form, twin, n in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
            names = explain(form, twin)
            key = " ".join(names)
            shown = _characters(form, twin) or [(g, c) for g, c in zip(_gaps(form), _gaps(twin)) if names and len(c) == 1]
            # only characters that are mapped one by one say something about other texts
            table = hypotheses()
            times = Counter((e, x) for e, x in shown if e != x and (not names or table[names[0]].undo(e) == x))
            if names:
                times[None, None] = 1
            for (e, x), k in times.items():
                had = found.setdefault((key, e, x), [0, 0])
                had[0] += 1
                had[1] += n * k
        yield pa.RecordBatch.from_pylist([dict(zip(_MAPPINGS.names, (*k, *v))) for k, v in found.items()], schema=_MAPPINGS)


def learned_mappings(pairs: DataFrame, twin_rows: int = TWIN_ROWS) -> DataFrame:
    """``names, garbled, clean, pairs, rows``: character mappings, the transformations that make them, the twin pairs that show them and how often these have them.

    Rows with null characters count whole pairs; those without names are of
    pairs that no transformation explains.  A mapping is of one character
    each, so there are at most as many rows as pairs of characters.
    """
    unlike = pairs.where((F.col("form") != F.col("twin")) & (F.col("n_twin") >= twin_rows) & (F.col("n_twin") >= twin_rows * F.col("n")))
    shown = unlike.select("form", "twin", "n").mapInArrow(_support, "names string, garbled string, clean string, pairs bigint, rows bigint")
    return shown.groupBy("names", "garbled", "clean").agg(F.sum("pairs").alias("pairs"), F.sum("rows").alias("rows"))


def own_mappings(unexplained: list[tuple[str, str, int, int]], counts: np.ndarray) -> list[OwnMapping]:
    """Transformations of mappings (garbled, clean, pairs, rows) that no encoding explains, one for each width.

    A mapping counts if nearly all pairs with its garbled part agree in it,
    and most occurrences of the part's first character stand in such pairs:
    letters that words merely differ in occur mostly elsewhere.
    """
    total: Counter[str] = Counter()
    of_first: Counter[str] = Counter()
    for g, _, pairs, rows in unexplained:
        total[g] += pairs
        of_first[g[0]] += rows
    kept: dict[int, dict[str, str]] = {}
    for g, x, pairs, _ in unexplained:
        if pairs >= OWN_PAIRS and pairs >= AGREEING * total[g] and of_first[g[0]] >= OF_ALL * counts[ord(g[0]) & (UNI - 1)]:
            kept.setdefault(len(g), {})[g] = x
    return [OwnMapping(width, m) for width, m in sorted(kept.items())]


def learned(rows: list, support: dict[str, int], counts: np.ndarray) -> tuple[dict[str, dict[str, str]], list[OwnMapping]]:
    """The mappings of each transformation that was chosen, and the transformations of mappings alone."""
    mappings: dict[str, dict[str, str]] = {name: {} for name in support}
    for r in rows:
        for name in (r["names"] or "").split(" ") if r["garbled"] is not None else ():
            if name in mappings:
                mappings[name][r["garbled"]] = r["clean"]
    return mappings, own_mappings([(r["garbled"], r["clean"], r["pairs"], r["rows"]) for r in rows if not r["names"] and r["garbled"] is not None], counts)


def fewest(explained: dict[str, int], min_support: int = MIN_SUPPORT) -> dict[str, int]:
    """Few transformations that explain the pairs, each with the pairs that only it of those explains (greedy cover).

    ``explained`` counts pairs by the names, separated by spaces, that explain
    them: encodings that differ in rare characters explain mostly the same.
    """
    left = {frozenset(k.split(" ")): n for k, n in explained.items()}
    order = {name: i for i, name in enumerate(hypotheses())}
    chosen: dict[str, int] = {}
    while left:
        gains: Counter[str] = Counter()
        for names, n in left.items():
            for name in names:
                gains[name] += n
        best = min(gains, key=lambda x: (-gains[x], order[x]))
        if gains[best] < min_support:
            break
        chosen[best] = gains[best]
        left = {k: n for k, n in left.items() if best not in k}
    return chosen


# -- applying --------------------------------------------------------------------------------------------------


def _with_mappings(mappings: dict[str, dict[str, str]], own: list[OwnMapping]) -> dict[str, Transformation | OwnMapping]:
    """All transformations by name, those with learned mappings as copies that hold these."""
    made: dict[str, Transformation | OwnMapping] = dict(hypotheses())
    for name, m in mappings.items():
        made[name] = t = copy.copy(made[name])
        t.mappings = m
    return made | {t.name: t for t in own}


class Restorer:
    """Finds the transformation under which a line becomes most usual, and undoes it."""

    LEAST = 0.3  # gain of a run of words below which a line is not looked at further

    def __init__(self, counts: np.ndarray, support: dict[str, int], mappings: dict[str, dict[str, str]] | None = None, own: list[OwnMapping] | None = None):
        table = _with_mappings(mappings or {}, own or [])
        support = support | {t.name: MIN_SUPPORT for t in own or []}
        self.model, self.support = CharacterModel(counts), support
        seen = [chr(c) for c in np.flatnonzero(counts[:UNI]) if c > 127 and not 0xD800 <= c < 0xE000]
        usual = {c for c in seen if counts[ord(c)] >= 2 and unicodedata.category(c) not in ("Cc", "Co", "Cn")} - {REPLACED}
        self._usual = frozenset(usual)
        # what a single-byte mix-up hides are letters and signs of running text, not frames and blocks
        plain = {c for c in usual if unicodedata.category(c)[0] in "LP" or "\u00a0" <= c <= "\u00ff" or c in "€™№−"}
        self._order = sorted(table.values(), key=lambda t: (-support.get(t.name, 0), t.name))
        self._rank = {t.name: i for i, t in enumerate(self._order)}
        self._wide = [(t, t._byte) for t in self._order if t.wide and t._byte]
        self._own_wide = [t for t in self._order if t.wide and not t._byte]
        self._single = [t for t in self._order if not t.wide]
        self._tables = [{ord(c): x for c in t.domain if (x := t.undo(c)) is not None} for t in self._single]
        # per character, as bits: mix-ups that it can stem from, and those that change it
        self._able, self._moves = dict.fromkeys(seen, 0), dict.fromkeys(seen, 0)
        for i, (t, table) in enumerate(zip(self._single, self._tables, strict=True)):
            for c in seen:
                x = table.get(ord(c))
                if x is not None and x in plain and counts[ord(x)] >= RARER * counts[ord(c)]:
                    self._able[c] |= 1 << i
                    self._moves[c] |= 1 << i
                elif x is None and c in t._byte:
                    self._able[c] |= 1 << i
        self._learned = sum(1 << i for i, t in enumerate(self._single) if support.get(t.name, 0) >= MIN_SUPPORT)
        self._need = [GAIN[("wide" if t.wide else "single") + ("" if support.get(t.name, 0) >= MIN_SUPPORT else "_unlearned")] for t in self._order]
        self._known: dict[str, list[tuple[int, float, str]]] = {}

    def word(self, word: str) -> list[tuple[int, float, str]]:
        """(number of the transformation, gain, text before) of each way in which a word can have been garbled."""
        ways = self._known.get(word)
        if ways is None:
            ways = self._ways(word)
            if SPACE in word:
                whole = {k for k, _, _ in ways}
                ways = ways + [x for x in self._apart(word) if x[0] not in whole]
            if len(self._known) < 200_000:
                self._known[word] = ways
        return ways

    def _apart(self, word: str) -> list[tuple[int, float, str]]:
        """The ways of a word that holds no-break spaces of its own: those of its parts; a part without a way stays."""
        parts, rest = [], word.split(SPACE)
        while rest:
            part = rest.pop(0)
            # the space can be the last byte of a character
            if rest and part and not part[-1].isascii() and (x := self._ways(part + SPACE + rest[0])):
                parts.append((part + SPACE + rest.pop(0), x))
            else:
                parts.append((part, [] if part.isascii() else self._ways(part)))
        numbers = {k for _, x in parts for k, _, _ in x}
        out = []
        for k in sorted(numbers):
            gain, before = 0.0, []
            for part, x in parts:
                g, b = next(((g, b) for n, g, b in x if n == k), (0.0 if part.isascii() else -4.0, part))
                gain += g
                before.append(b)
            out.append((k, gain, SPACE.join(before)))
        return out

    def _ways(self, word: str) -> list[tuple[int, float, str]]:
        own = set(_OUTSIDE.findall(word))
        mask, moves = -1, 0
        for c in own:
            mask &= self._able.get(c, 0)
            moves |= self._moves.get(c, 0)
        mask &= moves if len(own) >= UNLEARNED_CHARACTERS else moves & self._learned
        befores: dict[str, list[int]] = {}
        while mask:
            low = mask & -mask
            mask ^= low
            i = low.bit_length() - 1
            befores.setdefault(word.translate(self._tables[i]), []).append(self._rank[self._single[i].name])
        ways = []
        run = _OUTSIDE_RUN.search(word)[0]
        if len(run) > 1:
            ways += [(self._rank[t.name], before) for t in self._own_wide if own <= t.domain and (before := t.undo(word)) is not None]
            for t, byte in self._wide:
                # the first run must begin like a sequence of bytes
                if 0xC1 < byte.get(run[0], 0) < 0xF5 and 0x7F < byte.get(run[1], 0) < 0xC0 and own <= t.domain:
                    before = t.undo(word)
                    if before and all(c in self._usual or c != REPLACED and unicodedata.category(c)[0] in "LMNPS" for c in _OUTSIDE.findall(before)):
                        ways.append((self._rank[t.name], before))
        if not befores and not ways:
            return []
        base, score = self.model.score(word), self.model.score
        out = [(i, score(before) - base + CHANCE, before) for i, before in ways]
        for before, which in befores.items():
            gain = score(before) - base
            out += [(i, gain, before) for i in which]
        return out

    def line(self, line: str) -> tuple[str | None, float, str | None]:
        """Best transformation (None if none gains), its gain, and the line with it undone in its runs of words.

        A word that a transformation can't have made ends its run.  What is
        left of the line is looked at again; runs of any transformation that
        suffice by themselves are undone, and the first of those is the best.
        """
        words = line.split(" ")
        ways = [(i, self.word(w)) for i, w in enumerate(words) if not w.isascii()]
        found: list[tuple[int, float, list[tuple[int, str]]]] = []
        while got := self._runs(ways):
            taken = set()
            for k, total, first, last in got:
                before = [(i, next((b for n, _, b in x if n == k), words[i])) for i, x in ways[first : last + 1]]
                found.append((k, total, before))
                taken.update(range(first, last + 1))
            ways = [(i, [] if j in taken else x) for j, (i, x) in enumerate(ways)]
        if not found:
            return None, 0.0, None
        best, total, _ = main = next((x for x in found if x[1] >= self._need[x[0]]), found[0])
        for x in found:
            if x is main or x[1] >= self._need[x[0]]:
                for i, before in x[2]:
                    words[i] = before
        return self._order[best].name, total, " ".join(words)

    def _runs(self, ways: list[tuple[int, list[tuple[int, float, str]]]]) -> list[tuple[int, float, int, int]]:
        """The runs (transformation, gain, first, last) of the transformation with the best run, that one first."""
        most: dict[int, float] = {}
        for _, x in ways:
            for k, gain, _ in x:
                if gain > 0:
                    most[k] = most.get(k, 0.0) + gain
        total, best = self.LEAST, []
        for k in sorted(most):
            if most[k] <= total:
                continue
            runs, sum_, start = [], 0.0, 0
            for j, (_, x) in enumerate(ways):
                sum_ += next((g for n, g, _ in x if n == k), -4.0)
                if sum_ <= 0:
                    sum_, start = 0.0, j + 1
                elif sum_ > self.LEAST:
                    if not runs or runs[-1][2] != start:
                        runs.append((k, sum_, start, j))
                    elif sum_ > runs[-1][1] + 1e-9:
                        runs[-1] = (k, sum_, start, j)
            top = max((r[1] for r in runs), default=0.0)
            if top > total + 1e-9:
                total, best = top, runs
        # names beside a run are as rare one way as the other: they are taken back with it
        out, free = [], 0
        for n, (k, gain, first, last) in enumerate(best):
            left, stop = gain, best[n + 1][2] if n + 1 < len(best) else len(ways)
            beside = lambda j: next((g for m, g, _ in ways[j][1] if m == k), -99.0)  # noqa: B023, E731
            while last + 1 < stop and (g := beside(last + 1)) > -BESIDE and left + g > GAIN["single"]:
                left, last = left + min(g, 0.0), last + 1
            while first > free and (g := beside(first - 1)) > -BESIDE and left + g > GAIN["single"]:
                left, first = left + min(g, 0.0), first - 1
            free = last + 1
            out.append((k, gain, first, last))
        return sorted(out, key=lambda r: -r[1])


_RESULT = pa.schema([("doc_id", pa.int64()), ("line_no", pa.int32()), ("line", pa.string()), ("name", pa.string()),
                     ("gain", pa.float64()), ("restored", pa.string()), ("lost", pa.bool_()), ("changed", pa.string())])
_RESULT_DDL = "doc_id bigint, line_no int, line string, name string, gain double, restored string, lost boolean, changed string"


def _changed(line: str, restored: str | None) -> str | None:
    """The different characters that undoing a transformation took away."""
    return None if restored is None else "".join(sorted(set(_OUTSIDE.findall(line)) - set(_OUTSIDE.findall(restored))))


_in_worker: dict[str, tuple[Restorer, dict[str, tuple[str | None, float, str | None]]]] = {}


def _apply(counts, support: dict[str, int], mappings: dict[str, dict[str, str]], own: list[OwnMapping]):
    run_id = uuid.uuid4().hex

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if run_id not in _in_worker:  # a Python worker does many tasks of a run and remembers words and lines
            _in_worker.clear()
            _in_worker[run_id] = (Restorer(counts.value, support, mappings, own), {})
        restorer, known = _in_worker[run_id]
        for batch in batches:
            rows = []
            for doc_id, line_no, line in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                got = known.get(line)
                if got is None:
                    got = restorer.line(line)
                    if len(known) < 100_000:
                        known[line] = got
                lost = REPLACED in line
                keep = got[0] is not None or lost
                rows.append((doc_id, line_no, line if keep else None, got[0], got[1], got[2], lost, _changed(line, got[2])))
            yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*rows), _RESULT.types)] if rows else
                                  [pa.array([], t) for t in _RESULT.types], schema=_RESULT)

    return run


def garbled_lines(trec_line: DataFrame, min_support: int = MIN_SUPPORT) -> DataFrame:
    """Garbled lines with their text given back: ``doc_id, line_no, line, transformation, gain, restored``.

    ``transformation`` is null and ``restored`` holds the twin's words where
    characters were replaced by U+FFFD; words without a twin stay as they are.
    Null, blank and pure ASCII lines are never found; rows delivered twice are
    one line; an empty table gives no rows.  Line texts of any length are
    looked at as a whole.
    """
    spark = trec_line.sparkSession
    rows = trec_line.where("doc_id IS NOT NULL AND line_no IS NOT NULL").select("doc_id", "line_no", "line")
    rows = rows.where("octet_length(line) > length(line)")  # holds a character outside ASCII
    counted = statistics(rows.select("line"))
    counts = spark.sparkContext.broadcast(character_counts(counted))  # tables of fixed size
    pairs = twins(counted)
    # mappings of single characters and sets of hypotheses, as many as there are of these, whatever the number of lines
    shown = learned_mappings(pairs).collect()
    support = fewest({r["names"]: r["pairs"] for r in shown if r["garbled"] is None}, min_support)
    mappings, own = learned(shown, support, counts.value)
    found = materialize(rows.mapInArrow(_apply(counts, support, mappings, own), _RESULT_DDL), "candidates")
    return _with_twins(_decided(found, counts.value, support | {t.name: min_support for t in own}, min_support), pairs)


def _markers(sure: DataFrame, counts: np.ndarray) -> list[str]:
    """Characters that hardly stand outside of ``sure``'s lines; at most one row per character reaches the driver."""
    each = sure.select(F.explode(F.split(F.regexp_replace("line", "[\\x00-\\x7F]+", ""), "")).alias("c")).where("c <> ''")
    rows = each.groupBy("c").agg(F.count(F.lit(1)).alias("n")).collect()
    return [r["c"] for r in rows if r["n"] >= MARKER * counts[ord(r["c"]) & (UNI - 1)]]


def _decided(found: DataFrame, counts: np.ndarray, support: dict[str, int], min_support: int) -> DataFrame:
    """Candidates whose gain suffices: by itself, with characters that mark garbled text, or on a page garbled the same way."""
    table = hypotheses()
    wide = [n for n, t in table.items() if t.wide] + [n for n in support if n not in table and n != "learned>1"]
    learned = [n for n in (*table, *(n for n in support if n not in table)) if support.get(n, 0) >= min_support]
    is_wide, is_learned = F.col("name").isin(wide), F.col("name").isin(learned)
    need = (
        F.when(is_wide & is_learned, GAIN["wide"]).when(is_wide, GAIN["wide_unlearned"])
        .when(is_learned, GAIN["single"]).otherwise(GAIN["single_unlearned"])
    )
    on_page = F.when(is_wide, GAIN["wide_page"]).otherwise(GAIN["single_page"])
    reading = F.concat(is_wide.cast("string"), F.element_at(F.split("name", ">"), -1))
    # a row delivered twice is one line
    pages = found.select("doc_id", "line_no").distinct().groupBy("doc_id").agg(F.count(F.lit(1)).alias("lines"))
    once = found.where("name IS NOT NULL OR lost").groupBy("doc_id", "line_no").agg(
        F.max(F.struct("gain", "name", "line", "restored", "lost", "changed")).alias("x")
    ).select("doc_id", "line_no", "x.*")
    sure = F.coalesce(F.col("gain") >= need, F.lit(False))
    marks = "".join(_markers(once.where(sure), counts))
    marked = is_learned & (F.col("gain") >= GAIN["marked"]) & (F.col("changed") != "") & (F.translate("changed", marks, "") == "")
    once = once.withColumn("reading", reading).withColumn("strong", sure | F.coalesce(marked, F.lit(False)))
    # lines with other characters per page, and how many of them were surely read in each wrong way
    strong = once.where("strong").groupBy("doc_id", "reading").agg(F.count(F.lit(1)).alias("garbled"))
    usual = strong.join(pages, "doc_id").where("garbled >= 2 AND 2 * garbled >= lines").select("doc_id", "reading", F.lit(True).alias("page"))
    kept = once.join(usual, ["doc_id", "reading"], "left")
    weak = F.col("page") & (F.col("gain") >= on_page)
    sure = F.col("strong") | F.coalesce(weak, F.lit(False))
    return kept.where(sure | F.col("lost")).select(
        "doc_id", "line_no", "line", F.when(sure, F.col("name")).alias("transformation"), "gain",
        F.when(sure, F.col("restored")).otherwise(F.col("line")).alias("restored"), "lost",
    )


def _with_twins(decided: DataFrame, pairs: DataFrame) -> DataFrame:
    """Words with U+FFFD replaced by the frequent clean form of the same skeleton, where there is one."""
    top = pairs.where((F.col("form") == F.col("twin")) & (F.col("n") >= TWIN_ROWS) & ~F.col("form").contains(REPLACED)).select("skeleton", "twin")
    words = (
        decided.where("lost")
        .select("doc_id", "line_no", F.posexplode(F.split("restored", " ")).alias("at", "word"))
        .withColumn("skeleton", F.when(F.col("word").contains(REPLACED), F.regexp_replace("word", "[^\\x00-\\x7F]+", "")))
    )
    filled = words.join(top, "skeleton", "left").groupBy("doc_id", "line_no").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", F.coalesce("twin", "word").alias("w")))), lambda x: x["w"]), " ").alias("filled")
    )
    return decided.join(filled, ["doc_id", "line_no"], "left").select(
        "doc_id", "line_no", "line", "transformation", "gain", F.coalesce("filled", "restored").alias("restored")
    )
