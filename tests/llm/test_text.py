"""Word splitting, hashes and folds against plain Python."""

import random
import re

import numpy as np
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st

from sondage.llm import bpe, decontam, langid, simhash, substring_dedup, text, token_pack, toxicity

LOWER = str.maketrans({c: c + 32 for c in range(65, 91)})
texts = st.lists(st.text(alphabet="aB 1\n\té\x0b\x85Å.", max_size=40), min_size=1, max_size=8)


@settings(deadline=None, max_examples=60)
@given(texts)
def test_words(docs):
    for inside, lower, pattern in ((text.NOT_SPACE, False, "[^\x20\x09-\x0d]+"), (text.ALNUM, True, "[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")):
        words = text.Words([d.encode() for d in docs], inside, lower)
        want = [re.findall(pattern, d.translate(LOWER) if lower else d) for d in docs]
        got = [words.data[a:b].tobytes().decode() for a, b in zip(words.start, words.end, strict=True)]
        assert got == [w for ws in want for w in ws]
        assert words.counts.tolist() == [len(w) for w in want]
        joined, at = words.joined()
        assert joined.tobytes().decode() == "".join(w + " " for ws in want for w in ws) and at[-1] == len(joined)
        hashes = words.hashes()
        assert len(set(hashes.tolist())) == len(set(got))


@settings(deadline=None, max_examples=40)
@given(st.lists(st.integers(0, 90), min_size=1, max_size=120), st.integers(0, 3))
def test_xxh64(sizes, seed):
    data = np.frombuffer(random.Random(seed).randbytes(4000), dtype=np.uint8)
    start = np.array([(31 * i) % 3900 for i in range(len(sizes))])
    size = np.array(sizes)
    got = text.xxh64(data, start, size, 42)
    assert got.tolist() == [xxhash.xxh64_intdigest(data[a : a + n].tobytes(), 42) for a, n in zip(start.tolist(), size.tolist(), strict=True)]


def test_xxh64_groups():
    data = np.frombuffer(random.Random(5).randbytes(9000), dtype=np.uint8)
    for n in (0, 1, 3, 4, 7, 8, 15, 31, 32, 33, 63, 64, 100, 511, 513):
        start = np.arange(40) * 200
        assert text.xxh64(data, start, np.full(40, n), 42).tolist() == [xxhash.xxh64_intdigest(data[a : a + n].tobytes(), 42) for a in start.tolist()]


@pytest.mark.parametrize("period", range(1, 14))
def test_difference_cover(period):
    cover = substring_dedup.difference_cover(period)
    assert {(a - b) % period for a in cover for b in cover} == set(range(period))


@settings(deadline=None, max_examples=60)
@given(st.lists(st.integers(0, 2**64 - 1), min_size=1, max_size=40), st.lists(st.integers(0, 3), min_size=1, max_size=40), st.integers(0, 20))
def test_gray_index_finds_all(prints, buckets, radius):
    n = min(len(prints), len(buckets))
    p = np.array([x & 0xFFFF for x in prints[:n]], dtype=np.uint64)
    b = np.array(buckets[:n], dtype=np.int64)
    order = np.lexsort((simhash.gray_rank(p), b))
    p, b = p[order], b[order]
    index = simhash.GrayIndex(b, p)
    got = sorted(zip(*(x.tolist() for x in index.search(0, n, radius)), strict=True))
    want = sorted((i, j, int(p[i] ^ p[j]).bit_count()) for i in range(n) for j in range(i) if b[i] == b[j] and int(p[i] ^ p[j]).bit_count() <= radius)
    assert got == want


def test_links_join_dense_groups_without_all_pairs():
    rng = np.random.default_rng(1)
    p = np.concatenate([np.full(1, 7, dtype=np.uint64) ^ (np.uint64(1) << rng.integers(0, 64, 3000, dtype=np.uint64))])
    p = np.unique(p)
    b = np.zeros(len(p), dtype=np.int64)
    order = np.lexsort((simhash.gray_rank(p), b))
    i, j = simhash.link(b, p[order], 3, budget=50)
    assert len(i) == len(p) - 1


@settings(deadline=None, max_examples=80)
@given(st.lists(st.integers(1, 32), max_size=60))
def test_packing(sizes):
    rows = token_pack.pack(sizes, 32)
    assert sorted(i for r in rows for i in r) == list(range(len(sizes)))
    room = []
    for i in sorted(range(len(sizes)), key=lambda i: -sizes[i]):  # best fit, tried one by one
        fits = [k for k in range(len(room)) if room[k] >= sizes[i]]
        if fits:
            room[min(fits, key=lambda k: room[k])] -= sizes[i]
        else:
            room.append(32 - sizes[i])
    assert sorted(32 - sum(sizes[i] for i in r) for r in rows) == sorted(room)


def test_automaton_against_brute_force():
    rng = random.Random(3)
    for n in (1, 2, 3, 5):
        items = [(str(k), [rng.choice("abc") for _ in range(rng.randint(1, 9))]) for k in range(6)]
        auto = decontam.Automaton([(k, [w.encode() for w in item]) for k, item in items], n)
        for _ in range(40):
            words = [rng.choice("abcd") for _ in range(rng.randint(0, 25))]
            want = set()
            for k, (_, item) in enumerate(items):
                size = min(n, len(item))
                for a in range(len(item) - size + 1):
                    want |= {(i + size, size, k) for i in range(len(words) - size + 1) if words[i : i + size] == item[a : a + size]}
            got = {(end, size, k) for end, size, state in auto.stream([w.encode() for w in words]) for k in auto.owners(size, state)}
            assert got == want


@pytest.mark.parametrize("spelling", ["idiot", "IDIOT", "1d1ot", "ıdiot", "idiοt", "ｉｄｉｏｔ", "íd!ot"])
def test_fold(spelling):
    assert "idiot" in toxicity.folded([f"you {spelling} there".encode()])[0]


def test_fold_keeps_signs_at_edges():
    assert toxicity.folded([b"loser!"]) == [" ioser "]
    assert toxicity.folded([b"", b"  "]) == ["  ", "  "]


def test_encoder_is_the_library():
    from tokenizers import Tokenizer

    library, coder = Tokenizer.from_file(bpe.default_path()), bpe.Encoder(bpe.Vocabulary(bpe.default_path()), keep=50)
    rng = random.Random(2)
    alphabet = ["a", "A", "b", "B", "'s", "'T", "'re", "L", " ", "  ", "\n", "\t", "\x1c", "\x1f", "\x85", "\xa0", "é", "É", "é", "Å", "İ", "Σ", "ς", "<|endoftext|>", "<|startoftext|>", "<|", "12", "½", "²", "汉字", "🙂", "‍", "​", "ſ", "K", "ǅ", "!", "?.", ",&*", "$%#", "the", "ing", "\x00"]
    docs = ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 40))) for _ in range(1500)] + ["", "x" * 3000, "&*" * 400, "<|endoftext|>" * 3, "ab" * 200]
    for low in range(0, len(docs), 200):
        own = docs[low : low + 200]
        ids, counts = coder.encode(own)
        at = np.concatenate(([0], np.cumsum(counts)))
        for d, a, b in zip(own, at, at[1:], strict=False):
            assert ids[a:b].tolist() == library.encode(d, add_special_tokens=False).ids, d


def test_encoder_on_every_code_point():
    from tokenizers import Tokenizer

    library, coder = Tokenizer.from_file(bpe.default_path()), bpe.Encoder(bpe.Vocabulary(bpe.default_path()))
    points = [c for c in range(0x20, 0x33500) if not 0xD800 <= c < 0xE000] + [*range(0x3CFF0, 0x3D010), *range(0x3FC30, 0x3FC50), *range(0xE0000, 0xE0200)]
    for low in range(0, len(points), 20000):
        own = [f"a{chr(c)}.b" for c in points[low : low + 20000]]
        ids, counts = coder.encode(own)
        at = np.concatenate(([0], np.cumsum(counts)))
        for d, e, a, b in zip(own, library.encode_batch(own, add_special_tokens=False), at, at[1:], strict=False):
            assert ids[a:b].tolist() == e.ids, d.encode("unicode_escape")


def test_pairs_of_marks():
    import unicodedata

    from tokenizers import Tokenizer
    from tokenizers.normalizers import NFC

    library = NFC().normalize_str
    marks = [chr(c) for c in range(0x110000) if unicodedata.combining(chr(c))] + ["\U00011930", "\U00011935"]
    for a in marks:
        for base in "qe":
            got = [bpe.nfc(base + a + b) for b in marks]
            assert got == [library(base + a + b) for b in marks], hex(ord(a))
    known, coder = Tokenizer.from_file(bpe.default_path()), bpe.Encoder(bpe.Vocabulary(bpe.default_path()))
    own = [f"x{base}{a}{b}y" for base in "qe" for a in ("\u0301", "\u094d", "\u0323") for b in marks] + [f"x{b}{a}\u0327" for a in ("\u0301", "\u0345") for b in marks]
    ids, counts = coder.encode(own)
    at = np.concatenate(([0], np.cumsum(counts)))
    for d, e, a, b in zip(own, known.encode_batch(own, add_special_tokens=False), at, at[1:], strict=False):
        assert ids[a:b].tolist() == e.ids, d.encode("unicode_escape")


def test_ngrams_do_not_depend_on_neighbours():
    texts = [b"one two", b"", b"x", "\u00c9t\u00e9 und".encode(), b"last"]
    together, n = langid.vectors(texts, 1024)
    for i, t in enumerate(texts):
        alone, m = langid.vectors([t], 1024)
        assert (alone[0] == together[i]).all() and m[0] == n[i]
