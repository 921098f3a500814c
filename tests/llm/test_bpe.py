import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
import tiktoken

from phasewell.llm import bpe, queries

from . import docs


@pytest.fixture(scope="module")
def enc():
    return bpe.encoder(queries.MULTI_RANKS)


@pytest.fixture(scope="module")
def want(enc):
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=enc.vocabulary.ranks, special_tokens={})


def ids(raw):
    return np.frombuffer(raw, "<u4").tolist()


def test_texts(enc, want):
    odd = ["a\t \tb", "a\n b", "x \n", " lead", "trail ", "a\u00a0b c\u2003d", "a\x1cb \x1d c", "<|endoftext|> x", "it's we'LL don't", "aaaaaaaaaaaaaaaa" * 40, "\n\n\na", "1234567 89", "e\u0301 \u0301", "\u00a0 a", "a \u00a0", "a\u0085\nb", "\r\n\r\n x"]
    for t in [*(x or "" for x in docs.texts()), *odd]:
        got = enc.encode(t)
        assert ids(got) == want.encode_ordinary(t), t[:50]
        assert enc.decode(got).decode() == t


def test_random_bytes_against_merging(enc):
    rng = random.Random(3)
    v = enc.vocabulary
    tokens = list(v.ranks)
    for _ in range(1500):
        data = b"".join(rng.choice(tokens)[:8] for _ in range(rng.randint(1, 6))) if rng.random() < 0.7 else bytes(rng.randrange(256) for _ in range(rng.randint(1, 24)))
        assert [v.bytes_of[i] for i in bpe.Prefixes(v, data).ids()] == v.merged(data)


def test_appends_and_edits(enc):
    rng = random.Random(9)
    v = enc.vocabulary
    p = bpe.Prefixes(v, b"the quick brown")
    for _ in range(60):
        more = bytes(rng.choice(b"abcdefghi ") for _ in range(rng.randint(0, 5)))
        if rng.random() < 0.5:
            p.append(more)
        else:
            at = rng.randint(0, len(p.data))
            p.edit(at, rng.randint(0, 4), more)
        assert [v.bytes_of[i] for i in p.ids()] == v.merged(bytes(p.data)) or not p.data


def test_every_character_class(enc, want):
    for c in [*range(1, 0x3000, 7), *range(0x3000, 0xD800, 97), *range(0xE000, 0x20000, 211), 0x85, 0xA0, 0x1680, 0x180E, 0x200B, 0x2028, 0x3000, 0xFEFF]:
        t = f"a{chr(c)}b {chr(c)} {chr(c)}1{chr(c)}"
        assert ids(enc.encode(t)) == want.encode_ordinary(t), hex(c)


def test_table(spark, want):
    got = bpe.encode_table(docs.table(spark), queries.MULTI_RANKS).collect()
    plain = sorted(((r[0], want.encode_ordinary(r[1] or ""), r[1] or "") for r in docs.rows()), key=lambda x: (str(x[0]), x[2]))
    for r, (i, e, t) in zip(sorted(got, key=lambda r: (str(r.doc_id), r.n_tokens)), plain, strict=True):
        assert (r.doc_id, r.n_tokens, r.ids) == (i, len(e), e)
        assert r.ids_sha256 == hashlib.sha256(np.array(e, "<u4").tobytes()).hexdigest() and r.decoded_sha256 == hashlib.sha256(t.encode()).hexdigest()
    assert bpe.encode_table(docs.empty(spark), queries.MULTI_RANKS).collect() == []


def test_bounded_memory(enc):
    seen = []
    r = bpe.Remembered(lambda c: seen.append(c) or c.encode(), most=3)
    for _ in range(3):
        for c in "abc":
            assert r[c] == c.encode()
    for c in "defgh":
        r[c]
    assert len(r) <= 3 and len(r.old) <= 3 and seen == list("abcdefgh")


def test_another_pattern_takes_no_shortcut(enc):
    pattern = r"\p{L}|[^\p{L}]+"
    other, want = bpe.Encoder(enc.vocabulary, pattern), tiktoken.Encoding("other", pat_str=pattern, mergeable_ranks=enc.vocabulary.ranks, special_tokens={})
    for t in ("one two, three", " lead\n\nand more", ""):
        assert ids(other.encode(t)) == want.encode_ordinary(t)
