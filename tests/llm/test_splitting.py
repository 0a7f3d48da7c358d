from pathlib import Path

import pytest
from hypothesis import example, given, settings
from hypothesis import strategies as st

from inkwell.llm import splitting, tokens

pytestmark = pytest.mark.skipif(not Path(tokens.RANKS).exists(), reason="no vocabulary files here")

PROSE = "\n\n".join("The bridge was moved, and nobody saw it. It was found again. " * 4 for _ in range(12))


def check(text, limit, overlap, exact=True):
    whole = splitting.Text(text)
    pieces = whole.pieces(limit, overlap)
    encode = tokens.encoding().encode_ordinary
    assert pieces[0].start == 0 and pieces[-1].end == whole.n
    for p in pieces:
        assert p.n_tokens == len(encode(p.text)) and (p.n_tokens <= limit or not p.exact)
        assert p.exact or not exact
    for a, b in zip(pieces, pieces[1:]):
        assert (overlap <= a.end - b.start <= overlap + 3 or not b.exact) and b.end > a.end >= b.start > a.start
    glued, upto = b"", 0
    for p in pieces:
        glued += whole.data[whole.ends[max(upto, p.start)] : whole.ends[p.end]]
        upto = p.end
    assert glued.decode() == text
    return whole, pieces


@pytest.mark.parametrize("limit,overlap", [(16, 0), (50, 10), (128, 0), (60, 59 - 30)])
def test_prose(limit, overlap):
    whole, pieces = check(PROSE, limit, overlap)
    assert all(whole.strength[p.end] >= splitting.WORD for p in pieces[:-1])


def test_cuts_prefer_strong_boundaries():
    whole, pieces = check(PROSE, 128, 0)
    assert sum(whole.strength[p.end] >= splitting.SENTENCE for p in pieces[:-1]) == len(pieces) - 1
    sizes = [p.n_tokens for p in pieces[:-1]]
    assert max(sizes) <= 2 * min(sizes)


@pytest.mark.parametrize("text", ["x" * 3000, "日本語の長い文章。これは文です、はい。" * 60, "🙂🎉♥" * 200, "a\n" * 500, " " * 400 + "end", "мост был перенесён\u00a0и найден\u3000снова " * 60, "é \u2003 ü\u00a0\n" * 90, "\r\n\r\nline" * 90])
def test_texts_without_usual_boundaries(text):
    for limit, overlap in ((20, 0), (32, 8), (100, 0)):
        check(text, limit, overlap)


@given(st.text(st.sampled_from("ab c.!\n,é日。🙂\tж\u00a0\u3000\u2009”"), min_size=1, max_size=400), st.integers(8, 40), st.integers(0, 3))
@settings(deadline=None, max_examples=300)
@example(text="\u2009a\na.a\u2009", limit=8, overlap=3)
def test_any_text(text, limit, overlap):
    if splitting.Text(text).n > limit:
        check(text, limit, overlap, exact=limit >= 12)


@pytest.mark.parametrize("text", ["🙂" * 3000, "é日🙂\u2009" * 1500, "🙂🎉♥日é a" * 400])
@pytest.mark.parametrize("limit,overlap", [(8, 0), (8, 2), (16, 5), (32, 9), (64, 16)])
def test_characters_of_many_tokens(text, limit, overlap):
    whole, pieces = check(text, limit, overlap)
    # each piece but the last gets on by what limit and overlap leave, less what characters cut from both ends and its re-encoding
    assert len(pieces) <= 2 + whole.n / max(1, limit - overlap - 6)


@pytest.mark.parametrize("limit,overlap", [(1, 0), (2, 1), (5, 4), (8, 7)])
def test_limits_below_a_character_are_told(limit, overlap):
    whole, pieces = check("a🙂b\u2009🎉c" * 20, limit, overlap, exact=False)
    assert not all(p.exact for p in pieces)


def test_documents(spark, rows):
    docs = spark.createDataFrame([(1, PROSE), (2, "short"), (3, None), (4, ""), (1, PROSE)], "doc_id bigint, text string")
    got = splitting.split_documents(docs, [("a", 50, 0), ("b", 10_000, 10)]).collect()
    assert {r.doc_id for r in got} == {1} and {r.limit_name for r in got} == {"a"}
    one = sorted(r.piece_no for r in got)
    assert one == sorted(list(range(1, max(one) + 1)) * 2)
    assert rows(splitting.split_documents(docs.limit(0), [("a", 50, 0)])) == []
    assert rows(splitting.split_documents(docs, [])) == []
    with pytest.raises(ValueError):
        splitting.split_documents(docs, [("a", 5, 5)])


def test_sizes(spark, rows):
    docs = spark.createDataFrame([(1, "one two", "s"), (2, None, None), (3, "", "s")], "doc_id bigint, text string, source string")
    assert rows(tokens.sizes(docs, keep=("source",))) == [(1, "s", 2), (2, None, 0), (3, "s", 0)]
