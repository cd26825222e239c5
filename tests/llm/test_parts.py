"""Parts that need no Spark, against plain versions or the libraries they follow."""

import random

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from kadence.llm.boosting import BoostedTrees
from kadence.llm.language import LanguageProfiles, space
from kadence.llm.ngram_join import _search, shingle_set
from kadence.llm.packing import encoder, plan_packing
from kadence.llm.personal_data import SpanModel, base_spans
from kadence.llm.sequences import anchored, byte_elements, covered, words
from kadence.llm.token_counts import counter
from kadence.llm.vector_dedup import SmallWorld, links_of, unit

from . import brute

TEXT = st.text(alphabet=st.sampled_from("abAB1é日 \t\n\x0b\x85.,'<|>"), max_size=60)


@given(TEXT)
def test_words(text):
    data = text.encode()
    first, end, hashes = words(data)
    assert [data[a:b].decode() for a, b in zip(first, end, strict=True)] == brute.WORD.findall(text)
    by_word = {}
    for a, b, h in zip(first, end, hashes.tolist(), strict=True):
        assert by_word.setdefault(data[a:b], h) == h
    assert len(set(by_word.values())) == len(by_word)


def test_words_of_all_lengths_differ():
    data = b" ".join(b"x" * n for n in range(1, 70)) + b" " + b" ".join(b"x" * n + b"y" for n in range(70))
    assert len(set(words(data)[2].tolist())) == 139
    assert words(b"ABC abc", lower=True)[2].tolist()[0] == words(b"abc")[2][0]


@given(st.lists(st.text(alphabet="ab", max_size=40), max_size=6))
def test_equal_windows_share_an_anchor(texts):
    rows = [byte_elements(t.encode()) for t in texts]
    doc, first, last, anchor, content = anchored(rows, 8, 3)
    seen, windows = {}, set()
    for d, a, b, key, _ in zip(doc, first, last, anchor.tolist(), content, strict=True):
        for p in range(a, b + 1):
            assert seen.setdefault(texts[d][p : p + 8], key) == key
            windows.add((d, p))
    assert windows == {(d, p) for d, t in enumerate(texts) for p in range(len(t) - 7)}


def test_long_documents_are_cut_without_loss():
    rng = np.random.default_rng(1)
    row = rng.integers(0, 2**63, (1 << 20) + 5000).astype(np.uint64)
    _, first, last, _, _ = anchored([row], 35, 8)
    assert (last - first + 1).sum() == len(row) - 34
    assert first[0] == 0 and last[-1] == len(row) - 35


def test_covered():
    assert covered(6, np.array([1, 2]), 3).tolist() == [False, True, True, True, True, False]
    assert not covered(3, np.array([], int), 2).any()


@pytest.fixture(scope="module")
def word_path():
    return public_tokenizers.path("word_bpe_49k.json")


@settings(deadline=None, max_examples=200)
@given(st.one_of(TEXT, st.text(max_size=40)))
def test_token_counts_follow_the_library(text):
    path = public_tokenizers.path("word_bpe_49k.json")
    library = Tokenizer.from_file(path)
    assert counter(path).count(text) == len(library.encode(text, add_special_tokens=False).ids)


@pytest.mark.parametrize(
    "text", ["<|endoftext|>", "a<|startoftext|>b <|endoftext|>", "aaaaaaaaaaaaaaaaaaaaaaaaa", "x" * 5000, "don't WE'LL ½²", "é ́"]
)
def test_odd_counts(text, word_path):
    library = Tokenizer.from_file(word_path)
    assert counter(word_path).count(text) == len(library.encode(text, add_special_tokens=False).ids)


@settings(deadline=None, max_examples=200)
@given(st.lists(st.one_of(TEXT, st.text(max_size=40)), max_size=5))
def test_ids_follow_the_library(texts):
    path = public_tokenizers.path("byte_bpe_50k.json")
    library = Tokenizer.from_file(path)
    texts = [*texts, "a  b \n c <|endoftext|> x", "", "  ", "a \x1c b"]
    for ids, text in zip(encoder(path).encode(texts), texts, strict=True):
        assert np.frombuffer(ids, "<u4").tolist() == library.encode(text, add_special_tokens=False).ids


def _unfold(plan, histogram, limit):
    places = {}
    for length, first, number, sequence, offset in plan:
        for k in range(number):
            assert (length, first + k) not in places
            places[length, first + k] = (sequence + k, offset)
    assert sorted(places) == sorted((n, k) for n, c in histogram.items() for k in range(c))
    filled = {}
    for (length, _), (sequence, offset) in places.items():
        filled.setdefault(sequence, []).append((offset, length))
    for content in filled.values():
        at = 0
        for offset, length in sorted(content):
            assert offset == at
            at += length
        assert at <= limit
    return len(filled)


@given(st.dictionaries(st.integers(1, 64), st.integers(0, 12), max_size=20))
def test_packing_plans_are_whole(histogram):
    _unfold(plan_packing(histogram, 64), histogram, 64)


def test_packing_is_tight():
    rng = random.Random(4)
    histogram = {}
    for _ in range(5000):
        n = min(2048, max(1, int(rng.lognormvariate(6, 1.2))))
        histogram[n] = histogram.get(n, 0) + 1
    least = -(-sum(n * c for n, c in histogram.items()) // 2048)
    assert _unfold(plan_packing(histogram), histogram, 2048) <= 1.01 * least + 2
    # The size of a plan does not follow the counts.
    assert len(plan_packing({n: 1000 * c for n, c in histogram.items()})) < 20_000


@given(st.text(alphabet=st.sampled_from("ab1234567890.@+-() %é"), max_size=80))
def test_base_spans(text):
    assert base_spans(text) == brute.personal(text)


def test_base_spans_take_linear_time():
    for text in ("a" * 200_000, "1" * 200_000, "1." * 100_000, "@" * 100_000, "+1" * 100_000, "a@" * 100_000, "1 " * 100_000):
        assert base_spans(text) is not None


def test_model_without_trees_keeps_base_spans():
    assert SpanModel().spans("to me@x.org or +1 555 123 4567") == [
        ("email", 3, 11, True, 1.0), ("phone", 15, 30, True, 1.0)
    ]
    assert SpanModel().spans(None) == SpanModel().spans("") == []


def test_boosted_trees_learn_an_interaction():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(2000, 4))
    y = ((x[:, 0] > 0) ^ (x[:, 1] > 0.5)).astype(float)
    trees = BoostedTrees().fit(x[:1500], y[:1500])
    scores = np.array([trees.score(r) for r in x[1500:].tolist()])
    assert ((scores > 0.5) == y[1500:]).mean() > 0.9


def test_search_finds_all_components():
    rng = random.Random(2)
    texts = []
    for _ in range(12):
        base = [f"w{rng.randrange(500)}" for _ in range(rng.choice((6, 40, 120)))]
        for _ in range(8):
            copy = list(base)
            for _ in range(rng.randrange(4)):
                copy[rng.randrange(len(copy))] = f"v{rng.randrange(9)}"
            texts.append(" ".join(copy))
    expected = brute.jaccard(enumerate(texts))
    order = sorted(range(len(texts)), key=lambda i: len(shingle_set(texts[i].encode())))
    links = _search([shingle_set(texts[i].encode()) for i in order], 85)
    found = brute.components(range(len(texts)), [(order[a], order[b]) for a, b in links])
    assert {i: c for i, (_, c) in expected.items()} == found


def test_graph_finds_all_links():
    rng = np.random.default_rng(5)
    centres = rng.normal(size=(60, 16))
    rows = unit(np.concatenate([c + 0.12 * rng.normal(size=(n, 16)) for c, n in zip(centres, [150, *[12] * 59], strict=True)]))
    graph = SmallWorld(rows, np.arange(len(rows)))
    found, recall, _ = links_of(graph, rows, rows, 0.93)
    exact = rows @ rows.T >= 0.93
    assert recall == 1.0
    assert sum(map(len, found)) >= 0.999 * exact.sum()
    assert all(exact[i, near].all() for i, near in enumerate(found))


def test_profiles():
    settings_ = (512, 3, 7)
    one, two = space(*settings_).profile("the house of the hen"), space(*settings_).profile("das haus der hühner")
    profiles = LanguageProfiles(["a", "b"], np.stack([one, two]), settings_)
    label, score, letters = profiles.predict("the house")
    assert (label, letters) == ("a", True) and 0.3 < score <= 1
    assert profiles.predict("The HOUSE of the hen") == ("a", pytest.approx(1.0), True)
    assert profiles.predict(None) == profiles.predict("12 .") == ("und", 0.0, False)
    assert LanguageProfiles([], np.zeros((0, 512)), settings_).predict("abc") == ("und", 0.0, True)


def test_unseen_pieces_are_encoded_as_lines_of_one_text():
    """Two calls for many words, heads and lines; odd pieces give what the library gives, also beyond what is remembered."""
    from kadence.llm.packing import Encoder
    from kadence.llm.token_counts import default_path

    made = Encoder(default_path("byte_bpe_50k.json"), remembered=50)
    library, calls = made.library, []

    class Counted:
        def __getattr__(self, name):
            calls.append(name)
            return getattr(library, name)

    made.library = Counted()
    texts = [" ".join(f"w{i}x{k}," for i in range(300)) for k in range(2)]
    odd = ["a <|endoftext|> b<|endoftext|>c \n d\ne  f  g h\x1ci j\x85 it's 's ,\n", "", " ", "x " + "y" * 70 + " z", "é 　ü \r\n\t."]
    for some in (texts, odd, texts + odd):
        calls.clear()
        want = [np.array(library.encode(t, add_special_tokens=False).ids, "<u4").tobytes() for t in some]
        assert made.encode(some) == want
        if some is texts:
            assert len(calls) == 2
    assert all(len(p) <= 64 for p in made.known)
