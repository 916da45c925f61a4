"""Token counts and BPE against the public libraries."""

import base64
import random
from hashlib import sha256

import public_tokenizers as public
import pytest
import sentencepiece
import tiktoken

from mailveil.llm.bpe import PrefixTable, coder, decode, encode
from mailveil.llm.token_counts import counter, token_counts

PIECES = public.path("piece_bpe_32k.model")
RANKS = public.path("byte_bpe_50k.tiktoken")
BITS = ["the ", " ", "  ", "hello", "é", "ｱ", "\n", "\t", "aaaa", "=====", "'s", "日本語", "  \n",
        "...", "ing", "   ", "-----", "x" * 40, "ÄÖ", "\x00", "🙂", "1234567", "▁", "▁▁x", "</s>",
        " " * 15, " " * 16, " " * 47]


def random_texts(n):
    rnd = random.Random(5)
    for k in range(n):
        if k % 2:
            yield "".join(rnd.choice("abet the ingon=-#  é") for _ in range(rnd.randint(0, 60)))
        else:
            yield "".join(rnd.choice(BITS) for _ in range(rnd.randint(0, 14)))


@pytest.fixture(scope="module")
def library():
    with open(RANKS, "rb") as lines:
        ranks = {base64.b64decode(t): int(r) for t, r in map(bytes.split, lines)}
    return tiktoken.Encoding(
        "own", pat_str=public.PATTERN, mergeable_ranks=ranks, special_tokens={})


@pytest.mark.parametrize("chunk", [1, 2, 3, 7, 8192])
def test_counts_do_not_depend_on_chunks(chunk):
    count, model = counter(PIECES), sentencepiece.SentencePieceProcessor(model_file=PIECES)
    for text in random_texts(600):
        prefixes = count.prefix_counts(text, chunk)
        assert prefixes[-1] == len(model.encode(text)), repr(text)


def test_composition_is_associative():
    count, rnd = counter(PIECES), random.Random(8)
    for text in random_texts(200):
        text = " " + text.replace("▁", " ")
        a, b = sorted(rnd.randint(0, len(text)) for _ in range(2))
        maps = [count.map_chunk(t) for t in (text[:a], text[a:b], text[b:])]
        left = count.compose(count.compose(*maps[:2]), maps[2])
        right = count.compose(maps[0], count.compose(*maps[1:]))
        assert count.total(left) == count.total(right)


def test_token_counts(docs_of, odd_rows):
    model = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    got = sorted(map(tuple, token_counts(docs_of(odd_rows), PIECES).collect()), key=repr)
    want = [(i, len((t or "").encode()), len(model.encode(t or "")),
             len(model.encode(t or "")) > 4096) for i, t in odd_rows]
    assert got == sorted(want, key=repr)


def test_encode_and_decode(docs_of, odd_rows, library):
    coded = encode(docs_of(odd_rows), RANKS, public.PATTERN, digests=True)
    for row in decode(coded, RANKS, public.PATTERN).collect():
        ids = library.encode_ordinary(row.text or "")
        assert row.ids == ids and row.n_tokens == len(ids)
        assert bytes(row.decoded) == (row.text or "").encode()
        assert row.ids_sha256 == sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert row.decoded_sha256 == sha256((row.text or "").encode()).hexdigest()
    assert "source" in coded.columns and coded.columns.count("n_tokens") == 1


def test_encoding_is_the_library_s(library):
    code = coder(RANKS, public.PATTERN)
    for text in random_texts(1500):
        ids = code.encode(text)
        assert list(map(int, ids)) == library.encode_ordinary(text)
        assert code.decode(ids) == text.encode()


def test_appends_and_edits_are_exact():
    code, rnd = coder(RANKS, public.PATTERN), random.Random(2)
    for text in random_texts(400):
        data, more = text.encode(), rnd.choice(BITS).encode()
        table = PrefixTable(code.vocabulary, data)
        table.append(more)
        data += more
        start = rnd.randint(0, len(data))
        stop = rnd.randint(start, len(data))
        worked = table.edit(start, stop, more)
        data = data[:start] + more + data[stop:]
        assert table.ids() == PrefixTable(code.vocabulary, data).ids()
        assert worked <= len(data)


def test_a_small_edit_of_a_long_text_is_local():
    code = coder(RANKS, public.PATTERN)
    table = PrefixTable(code.vocabulary, b"some words of a text that goes on " * 200)
    assert table.edit(300, 305, b"other") < 200


def test_empty_tables(docs_of):
    assert token_counts(docs_of([]), PIECES).count() == 0
    assert encode(docs_of([]), RANKS, public.PATTERN).count() == 0
