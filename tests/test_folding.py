import unicodedata

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from veldrin.functions.folding import fold, fold_codes, likeness, to_codes, to_texts

TEXT = st.one_of(st.none(), st.text(max_size=30), st.text(alphabet="aÅΣσ１ア゙́カ゛\0 ,。ﾊﾟ½Ⅳ", max_size=12))


def plain(t):
    return "".join(c for c in unicodedata.normalize("NFKC", t or "").lower() if unicodedata.category(c)[0] in "LN")


def pieces(t):
    return {t[i : i + 3] for i in range(len(t) - 2)} or ({t} if t else set())


@settings(max_examples=200, deadline=None)
@given(st.lists(TEXT, max_size=8))
def test_fold_batches_like_single_texts(texts):
    safe = [None if t is None else t.replace("\0", " ") for t in texts]
    want = [plain(t) for t in safe]
    assert [fold(t) for t in safe] == want
    assert to_texts(*fold_codes(texts)) == want


@settings(max_examples=200, deadline=None)
@given(st.lists(st.tuples(st.text("abcあ", max_size=9), st.text("abcあ", max_size=9)), max_size=8))
def test_likeness_is_jaccard_of_pieces(pairs):
    got = likeness([a for a, _ in pairs], [b for _, b in pairs])
    for (a, b), x in zip(pairs, got):
        u = pieces(a) | pieces(b)
        assert x == (len(pieces(a) & pieces(b)) / len(u) if u else 1)


def test_code_points_round_trip():
    texts = ["", "a", "𝔘あ", "x" * 1000]
    assert to_texts(*to_codes(texts)) == texts
    assert to_codes([])[1].tolist() == [0]
    assert len(likeness([], [])) == 0 and isinstance(likeness(["a"], ["a"]), np.ndarray)


def test_canonical_inputs():
    from veldrin.functions.canonical import signature

    same = [("noul", '{"b": 1.0, "a": ["x  y"]}', "q?", None), (" Noul", '{ "a": ["x\\ty "], "b": 1}', " q? ", None)]
    assert len({signature(*s) for s in same}) == 1
    other = [("noul", '{"b": true, "a": ["x y"]}', "q?", None), ("noul", "b a x y", "q?", None), ("noul", '"b a x y"', "q?", None), ("noul", same[0][1], None, None), ("noul", same[0][1], "q?", '{"a": 1}')]
    assert len({signature(*s) for s in [same[0], *other]}) == 6
    assert signature("noul", "ＡＢ　c", "", "[1, 2]") == signature("noul", "AB c", "", "[1,2]") != signature("noul", "AB c", "", "[2, 1]")
    assert signature(None, "x", "", "") is None is signature("noul", None, "", "") and signature("noul", '{"a ": 1, "a": 2}', "", "") is None
