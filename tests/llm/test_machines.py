"""The parts without Spark: suffix arrays, the piece machine, the trie join, anchors, false discoveries."""

from __future__ import annotations

import random

import numpy as np
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st

from groundswell.llm import suffixes
from groundswell.llm.anchors import find_anchors
from groundswell.llm.pieces import MARK, Decoder, Encoder, Vocabulary, states
from groundswell.llm.queries import tokenizer_path
from groundswell.llm.secrets import least_bins
from groundswell.llm.simhash import trie_join


@settings(deadline=None, max_examples=200)
@given(st.lists(st.integers(1, 4), max_size=60), st.sampled_from([0, 2, 10**9]))
def test_suffix_array_and_prefixes(symbols, dense):
    text = [*symbols, 0]
    before, suffixes._DENSE = suffixes._DENSE, dense
    try:
        order = suffixes.suffix_array(np.array(text))
    finally:
        suffixes._DENSE = before
    assert order.tolist() == sorted(range(len(text)), key=lambda i: text[i:])
    shared = suffixes.permuted_prefixes(bytes(text), order)
    for j, i in zip(order, order[1:]):
        k = 0
        while text[i + k] == text[j + k]:
            k += 1
        assert shared[i] == k


@pytest.fixture(scope="module")
def machine():
    vocabulary = Vocabulary.load(tokenizer_path())
    return Encoder(vocabulary), Decoder(vocabulary), sentencepiece.SentencePieceProcessor(model_file=tokenizer_path())


TEXTS = st.text(st.sampled_from("ab e  thnorst.,\n12é日🙂<>/" + MARK), max_size=80)


@settings(deadline=None, max_examples=200)
@given(TEXTS)
def test_encoding_is_that_of_the_library_and_decodes(machine, text):
    encoder, decoder, library = machine
    ids = encoder.encode(text)
    if MARK not in text:
        assert ids == library.encode(text)
    assert decoder.decode(np.array(ids, np.int64), np.array([len(ids)])) == [text.encode()]


@settings(deadline=None, max_examples=150)
@given(TEXTS.filter(bool), st.sampled_from([16, 17, 23]), st.booleans())
def test_chunks_give_the_same_ids(machine, text, size, spaced):
    encoder = machine[0]
    text = text * 3 if spaced else (text * 3).replace(" ", "")
    if not text:
        return
    marked = MARK + encoder.marked(text)
    pieces = []
    for at in range(0, len(marked), size):
        low = max(0, at - encoder.longest)
        pieces.append((marked[low : at + size + encoder.longest], at - low, min(at + size, len(marked)) - low))
    at = states([encoder.transfer(t, a, b, i == 0) for i, (t, a, b) in enumerate(pieces)])
    ids = [x for (t, a, b), entry, exit_ in zip(pieces, at, at[1:]) for x in encoder.chunk_ids(t, a, b, entry, exit_)]
    assert ids == encoder.encode(text)


def test_unigram_weights_take_the_heaviest_path():
    pieces = ("<u>", "a", "b", "ab", "ba", MARK, *(f"<0x{b:02X}>" for b in range(256)))
    scores = (0.0, -1.0, -1.0, -1.5, -1.2, -0.5, *([0.0] * 256))
    encoder = Encoder(Vocabulary(pieces, scores, tuple(range(6, 262)), frozenset([0, *range(6, 262)]), "unigram"))
    assert encoder.encode("aba") == [5, 1, 4]  # -1 - 1.2 beats -1.5 - 1


def test_trie_join_links_as_brute_force():
    rng = random.Random(1)
    base = [rng.getrandbits(64) for _ in range(20)]
    fps = sorted({b ^ sum(1 << rng.randrange(64) for _ in range(rng.randrange(7))) & (2**64 - 1) for b in base for _ in range(6)})
    fps = np.array(fps, np.uint64)
    n = len(fps)
    links = trie_join(np.zeros(n, np.int64), np.zeros(n, bool), np.ones(n, bool), fps, 4)

    def groups(pairs):
        of = list(range(n))
        for _ in range(n):
            for i, j in pairs:
                of[i] = of[j] = min(of[i], of[j])
        return of

    every = [(i, j) for i in range(n) for j in range(i) if int(fps[i] ^ fps[j]).bit_count() <= 4]
    assert groups(links) == groups(every)
    assert len(links) == n - len(set(groups(every)))
    assert trie_join(np.empty(0, np.int64), np.empty(0, bool), np.empty(0, bool), np.empty(0, np.uint64), 4) == []


def test_equal_windows_have_equal_anchors():
    rng = random.Random(2)
    shared = bytes(rng.choices(b"abcdef ", k=300))
    texts = [bytes(rng.choices(b"xyz", k=50)) + shared, shared + b"q" * 120, b"", b"short"]
    owner, place, first, last, gram = find_anchors(texts, 100)
    of = {(o, s): (p - s, g) for o, p, a, b, g in zip(*(x.tolist() for x in (owner, place, first, last, gram))) for s in range(a, b + 1)}
    assert len(of) == sum(max(0, len(t) - 99) for t in texts)
    assert all(of[0, 50 + s] == of[1, s] for s in range(201))


def test_false_discovery_cut():
    assert least_bins([]) == {}
    assert least_bins([(0, 0, 1000)]) == {}
    assert least_bins([(0, 60, 10), (0, 0, 990)], fdr=0.05) == {0: 60}
