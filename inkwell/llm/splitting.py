"""Cutting oversized texts into pieces at natural boundaries.

The least number of pieces is computed, equal-length targets are placed, and
each cut moves to the strongest boundary near its target.  If a cut finds no
boundary, a piece is added and the targets are placed anew.  If a piece breaks
the limit when it is encoded alone, or the overlap can't be had, the targets
are placed anew after every cut, for the rest of the text: pieces are added
where they are needed, and the pass always ends.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from inkwell.llm import tokens

#: Strength of a boundary: end of a paragraph, a line, a sentence, a clause, a word; 0 inside a word; -1 inside a character.
PARAGRAPH, LINE, SENTENCE, CLAUSE, WORD, NONE, INSIDE = 5, 4, 3, 2, 1, 0, -1
NEAR = 0.25  # part of a piece's length that a cut may move
EXTRA = 3  # pieces added for want of a boundary; a broken limit adds as many as it takes
LONGER = 8  # tokens by which a part can be above the limit and still within it when encoded alone


@dataclass
class Piece:
    start: int  # first token
    end: int  # token after the last
    n_tokens: int  # of the piece encoded alone
    text: str
    exact: bool = True  # within the limit, and with the whole overlap to the piece before


class Text:
    """A text with its token boundaries and their strengths."""

    def __init__(self, text: str, path: str = tokens.RANKS, ids: list[int] | None = None):
        self._encode = tokens.encoding(path).encode_ordinary
        self.data = data = text.encode("utf-8", "replace")
        if ids is None:
            ids = self._encode(text)
        self.n = len(ids)
        ends = np.zeros(self.n + 1, dtype=np.int64)
        np.cumsum(tokens.byte_lengths(path)[ids], out=ends[1:])
        self.ends = ends
        b = np.frombuffer(data, dtype=np.uint8)
        inner = ends[1:-1]
        last, next_ = b[inner - 1], b[inner]
        strength = np.zeros(self.n + 1, dtype=np.int8)
        inside = strength[1:-1]
        kind_next, kind_last = _KIND[next_], _KIND[last]
        white_next, white_last = kind_next == _WHITE, kind_last == _WHITE
        at_word = white_next | white_last
        inside[at_word] = WORD
        # the character that ends the words before the boundary: one byte back, or two behind a space
        two = b[np.maximum(inner - 2, 0)]
        closing = np.where(white_last, _KIND[two], kind_last)
        inside[at_word & (closing == _CLAUSE)] = CLAUSE
        quoted = np.flatnonzero(at_word & (closing == _QUOTE))
        before = _KIND[b[np.maximum(inner[quoted] - 2 - white_last[quoted], 0)]]
        inside[at_word & (closing == _SENTENCE)] = SENTENCE
        inside[quoted[before == _SENTENCE]] = SENTENCE
        if len(data) != len(text):  # closing quotes and wide punctuation take three bytes
            third = b[np.maximum(inner - 3, 0)]
            inside[(next_ & 0xC0) == 0x80] = INSIDE
            solid = ~white_last
            wide = np.flatnonzero((third == 0xE2) | (third == 0xE3) | (third == 0xEF) | (third == 0xE1))
            if len(wide):
                kind = _WIDE[_place(third[wide], two[wide], last[wide])]
                inside[wide[(kind == _CLAUSE) & (inside[wide] < CLAUSE)]] = CLAUSE
                inside[wide[kind == _SENTENCE]] = SENTENCE
                quoted = wide[(kind == _QUOTE) & at_word[wide]]
                inside[quoted[_KIND[b[np.maximum(inner[quoted] - 4, 0)]] == _SENTENCE]] = SENTENCE
                solid[wide[kind == _WHITE]] = False
            solid[(two == 0xC2) & ((last == 0xA0) | (last == 0x85))] = False
        else:
            solid = ~white_last
        line = (last == 10) & (next_ != 10) & (next_ != 13)
        inside[line] = LINE
        inside[line & ((two == 10) | ((two == 13) & (b[np.maximum(inner - 3, 0)] == 10)))] = PARAGRAPH
        self.strength = strength
        # the last place at or before each token, and the first at or after it, that isn't inside a character
        self.back = self.on = None
        if (inner_character := strength == INSIDE).any():
            every = np.arange(self.n + 1)
            self.back = np.maximum.accumulate(np.where(inner_character, 0, every))
            self.on = np.minimum.accumulate(np.where(inner_character, self.n, every)[::-1])[::-1]
        # boundaries that the tokenizer's own splitting can't cross: encoding a part that begins there gives the same tokens
        self.safe = np.ones(self.n + 1, dtype=bool)
        self.safe[1:-1] = (white_next & solid) | ((last == 10) & (next_ > 32) & (next_ < 128))
        self.safe_end = self.safe.copy()
        self.safe_end[1:-1] &= ~white_last
        self._safe = self.safe_end.tobytes()  # searched as bytes, which is far quicker than slices of arrays
        self._strengths = (strength + 1).tobytes()

    def part(self, start: int, end: int) -> str:
        return self.data[self.ends[start] : self.ends[end]].decode("utf-8", "replace")

    def count(self, start: int, end: int) -> int:
        """Tokens of a part encoded alone; only its unsafe ends are encoded again."""
        if start == 0 or self.safe[start]:
            head, more = start, 0
        else:
            head = self._safe.find(1, start + 1, end)
            if head < 0:
                return len(self._encode(self.part(start, end)))
            more = len(self._encode(self.part(start, head)))
        if end == self.n or self.safe_end[end]:
            return more + end - head
        tail = self._safe.rfind(1, head, end)
        if tail < 0:
            return more + len(self._encode(self.part(head, end)))
        return more + tail - head + len(self._encode(self.part(tail, end)))

    def _whole_before(self, at: int) -> int:
        """The last place at or before a token that isn't inside a character."""
        return at if self.back is None else int(self.back[at])

    def _whole_after(self, at: int) -> int:
        return at if self.on is None else int(self.on[at])

    def _least_cut(self, start: int, overlap: int) -> int:
        """The first cut after which the next piece, ``overlap`` tokens back or at the character before, begins later than ``start``."""
        return self._whole_after(min(self._whole_after(start + 1) + overlap, self.n))

    def _strongest(self, low: int, high: int, target: int) -> int:
        """The strongest boundary from ``low`` to ``high``, of equal ones the nearest to the target."""
        target = min(max(target, low), high)
        for value in range(PARAGRAPH + 1, -1, -1):
            before, after = self._strengths.rfind(value, low, target + 1), self._strengths.find(value, target + 1, high + 1)
            if before >= 0 or after >= 0:
                return before if after < 0 or 0 <= target - before <= after - target and before >= 0 else after
        return low

    def cuts(self, pieces: int, limit: int, overlap: int) -> tuple[list[tuple[int, int]] | None, bool]:
        """Spans of about equal length (None if the overlap can't be had), and whether every cut is at a natural boundary."""
        n, spans, start, natural = self.n, [], 0, True
        step = (n - overlap) / pieces
        reach = max(1, int(step * NEAR))
        for j in range(1, pieces):
            target = round(j * step) + overlap
            least = self._least_cut(start, overlap)
            most = min(start + limit, n - 1)
            if least > most:
                return None, False
            rest = max(least, n - (pieces - j) * (limit - overlap))  # leaves what the other pieces can hold
            low, high = min(max(rest, target - reach), most), max(min(most, target + reach), least)
            cut = self._strongest(min(low, high), max(low, high), target)
            if self.strength[cut] < WORD:  # none nearby: any that leaves the rest within its pieces
                cut = self._strongest(min(rest, most), most, target)
            if self.strength[cut] == INSIDE:  # no whole character ends in reach
                cut = self._whole_before(cut)
                if cut < least:
                    return None, False
            natural &= bool(self.strength[cut] >= WORD)
            spans.append((start, cut))
            start = self._whole_before(cut - overlap)
        spans.append((start, n))
        return spans, natural

    def pieces(self, limit: int, overlap: int = 0) -> list[Piece]:
        """Ordered pieces within the limit; one piece where the whole text is.

        Consecutive pieces share ``overlap`` tokens of the text's tokens, more
        only as far as the overlap would begin inside a character (up to three
        tokens, where no token holds parts of two characters).  Where single
        characters take so many tokens that a limit has no room for one and
        the overlap, a piece shares as much as it can, and a character above
        the limit is a piece alone; these pieces are not ``exact``.
        """
        if limit < 1 or not 0 <= overlap < limit:
            raise ValueError("limit must be above the overlap")
        if self.n <= limit:
            return [Piece(0, self.n, self.n, self.part(0, self.n))] if self.n else []
        least = -(-(self.n - overlap) // (limit - overlap))
        found = None
        for k in range(least, least + EXTRA + 1):
            spans, natural = self.cuts(k, limit, overlap)
            if spans is None:
                break
            if found and not natural:
                continue
            if any(e - s > limit + LONGER for s, e in spans):
                continue
            counts = [self.count(s, e) for s, e in spans]
            if max(counts) <= limit:
                found = spans, counts
                if natural:
                    break
        if found:
            return [Piece(s, e, c, self.part(s, e)) for (s, e), c in zip(*found, strict=True)]
        return self._one_by_one(limit, overlap)

    def _one_by_one(self, limit: int, overlap: int) -> list[Piece]:
        """Pieces whose targets are placed anew after each cut, for what is left of the text."""
        n, out, start, done, exact = self.n, [], 0, 0, True
        while True:
            if n - start <= limit + LONGER and (c := self.count(start, n)) <= limit:
                out.append(Piece(start, n, c, self.part(start, n), exact))
                return out
            left = max(2, -(-(n - start - overlap) // (limit - overlap)))
            step = (n - start - overlap) / left
            cut = self._fitting(start, max(self._least_cut(start, overlap), done + 1), limit, start + overlap + round(step), max(1, int(step * NEAR)))
            if cut is not None:
                begin, whole = self._whole_before(cut - overlap), True
            else:  # no room for a character more and the overlap: a shorter one
                whole = False
                while (cut := self._fitting(start, done + 1, limit, start + limit, limit)) is None and start < done:
                    start, exact = self._whole_after(start + 1), False
                if cut is None:
                    cut, exact = self._whole_after(done + 1), False
                begin = min(max(self._whole_before(max(cut - overlap, 0)), self._whole_after(start + 1)), cut)
            out.append(Piece(start, cut, self.count(start, cut), self.part(start, cut), exact))
            if cut >= n:
                return out
            start, done, exact = begin, cut, whole or cut - begin >= overlap

    def _fitting(self, start: int, least: int, limit: int, target: int, reach: int) -> int | None:
        """The strongest boundary near the target up to which a piece is within the limit, else the nearest place, if any."""
        most = min(start + limit, self.n)
        if least > most:
            return None
        low, high = max(least, min(target - reach, most)), min(most, max(target + reach, least))
        cut = self._strongest(low, high, target)
        if self.strength[cut] != INSIDE and self.count(start, cut) <= limit:
            return cut
        at = np.arange(least, most + 1)
        at = at[self.strength[least : most + 1] != INSIDE]
        for cut in at[np.argsort(np.abs(at - target), kind="stable")].tolist():
            if self.count(start, cut) <= limit:
                return cut
        return None


_WHITE, _SENTENCE, _CLAUSE, _QUOTE = 1, 2, 3, 4
_KIND = np.zeros(256, dtype=np.int8)  # what a byte is
for _kind, _bytes in ((_WHITE, b" \t\n\v\f\r"), (_SENTENCE, b".!?"), (_CLAUSE, b",;:"), (_QUOTE, b"\"')]")):
    _KIND[list(_bytes)] = _kind


def _place(first, second, third):
    """Where a character of three bytes stands in the table of wide ones."""
    return (np.asarray(first, dtype=np.int32) & 15) << 16 | np.asarray(second, dtype=np.int32) << 8 | third


_WIDE = np.zeros(1 << 20, dtype=np.int8)  # what a character of three bytes is; first bytes E1, E2, E3 and EF only
for _kind, _characters in ((_WHITE, "\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"),
                           (_SENTENCE, "。！？…｡"), (_CLAUSE, "、，；："), (_QUOTE, "”’“」")):
    for _character in _characters:
        _WIDE[_place(*_character.encode())] = _kind

_DDL = "limit_name string, doc_id bigint, piece_no int, start_token bigint, end_token bigint, n_tokens int, exact boolean, text string"


def split_documents(documents: DataFrame, limits: list[tuple[str, int, int]], path: str = tokens.RANKS) -> DataFrame:
    """Pieces of every text above a limit, for each of ``limits`` (name, tokens, overlap).

    Returns ``limit_name, doc_id, piece_no, start_token, end_token, n_tokens,
    exact, text`` with pieces numbered from 1.  ``start_token`` and
    ``end_token`` count tokens of the whole text; ``n_tokens`` those of the
    piece encoded alone.  ``exact`` is false for a piece in which one
    character's tokens leave no room for limit or overlap.  Texts within a limit, null and empty ones have no rows; a row that
    stands twice is split twice.
    """
    for _, limit, overlap in limits:
        if limit < 1 or not 0 <= overlap < limit:
            raise ValueError("limits must be above their overlap")
    names = _DDL.replace(",", "").split()[::2]
    kinds = [pa.string(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.bool_(), pa.string()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = tokens.encoding(path).encode_ordinary
        least = min((limit for _, limit, _ in limits), default=0)
        for batch in batches:
            rows, held = [], 0
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if not text or not limits:
                    continue
                ids = encode(text)
                if len(ids) <= least:
                    continue
                whole = Text(text, path, ids)
                for name, limit, overlap in limits:
                    if whole.n > limit:
                        for i, p in enumerate(whole.pieces(limit, overlap), 1):
                            rows.append((name, doc_id, i, p.start, p.end, p.n_tokens, p.exact, p.text))
                            held += len(p.text)
                if held > 4_000_000:  # batches of bounded size
                    yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names=names)
                    rows, held = [], 0
            if rows:
                yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names=names)

    return documents.select("doc_id", "text").mapInArrow(run, _DDL)
