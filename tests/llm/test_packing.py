import json
import zlib
from collections import defaultdict

import numpy as np
import pytest
from tokenizers import Tokenizer

from phasewell.llm import packing, queries

from . import docs


def check(pieces, texts, width=2048):
    """texts: (doc_id, text); pieces of documents that share an id are told apart by their crc."""
    t = Tokenizer.from_file(queries.TOKENIZER)
    want = defaultdict(list)
    for i, x in texts:
        want[i].append(np.array([*t.encode(x or "", add_special_tokens=False).ids, 1], "<u4"))
    sequences = defaultdict(list)
    for p in pieces:
        sequences[p.sequence_id].append(p)
    padding = 0
    for s in sequences.values():
        at = 0
        for p in sorted(s, key=lambda p: p.offset):
            assert p.offset == at
            at += p.length
        assert 0 < at <= width
        padding += 0 if at & (at - 1) == 0 else width - at
    by_doc = defaultdict(list)
    for p in pieces:
        by_doc[p.doc_id].append(p)
    assert set(by_doc) == set(want)
    for i, ps in by_doc.items():
        assert sum(p.length for p in ps) == sum(map(len, want[i]))
        for p in ps:
            assert any(len(w) == p.doc_tokens and zlib.crc32(w[p.start : p.start + p.length].tobytes()) == p.ids_crc32 for w in want[i])
        if len(want[i]) == 1:
            at = 0
            for p in sorted(ps, key=lambda p: p.start):
                assert p.start == at
                at += p.length
    return padding / max(1, sum(p.length for p in pieces))


@pytest.mark.parametrize(("fan", "partitions"), [(64, 1), (64, 5), (2, 9)])
def test_pieces(spark, monkeypatch, fan, partitions):
    monkeypatch.setattr(packing, "FAN", fan)
    got = packing.pack(docs.table(spark).repartition(partitions), queries.TOKENIZER).collect()
    assert check(got, [r[:2] for r in docs.rows()]) == 0


def test_documents(spark):
    rows = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").collect()
    assert check(queries.op10_packing(spark, "/root/testdata/sf0.001").collect(), [tuple(r) for r in rows]) == 0


def test_special_and_odd_text(spark):
    odd = ["<|endoftext|>", "a<|endoftext|> b", "a \t b", "  x", "x\n\ny z", "Ünï中 文字 ’s don't 12.5%", "\u00a0 a", "ﬁ ⅷ ಠ_ಠ", "a\n", "e\u0301."]
    rows = [(i, t, *[None] * 7) for i, t in enumerate(odd)]
    assert check(packing.pack(docs.table(spark, rows), queries.TOKENIZER).collect(), [r[:2] for r in rows]) == 0


def test_empty(spark):
    assert packing.pack(docs.empty(spark), queries.TOKENIZER).collect() == []


def test_best_fit_and_powers():
    out = []
    p = packing.Packer(out.append, 8, 2)
    doc = lambda n: memoryview(bytes(4 * n))
    for k, n in enumerate((5, 6, 2, 7)):
        p.add(k, 0, doc(n), n)
    assert [[(d, s, len(i) // 4) for d, s, i, _ in w] for w in out] == [[(1, 0, 6), (2, 0, 2)]]
    p.add(9, 0, doc(4), 4)  # fits neither: the fullest takes its head
    assert [(d, s, len(i) // 4) for d, s, i, _ in out[-2]] == [(3, 0, 7), (9, 0, 1)]
    cut = list(packing.powers([7, [(0, 0, doc(5), 5), (1, 3, doc(2), 9)]]))
    assert [sum(len(i) // 4 for _, _, i, _ in s) for s in cut] == [4, 2, 1]


def test_tokenizer_with_a_prefix_space_takes_no_shortcut(tmp_path):
    t = Tokenizer.from_file(queries.TOKENIZER)
    changed = json.loads(t.to_str())
    changed["pre_tokenizer"]["add_prefix_space"] = True
    (tmp_path / "t.json").write_text(json.dumps(changed))
    mine, want = packing.Tokens(str(tmp_path / "t.json")), Tokenizer.from_file(str(tmp_path / "t.json"))
    assert not mine.short
    for x in ("one two three", "word.", ""):
        assert np.frombuffer(mine.ids(x), "<u4").tolist() == want.encode(x, add_special_tokens=False).ids


def test_words_go_to_the_model_once_whatever_marks_follow():
    mine, want = packing.Tokens(queries.TOKENIZER), Tokenizer.from_file(queries.TOKENIZER)
    model, asked, wholes = mine.model, [], []

    class Model:
        def tokenize(self, piece):
            asked.append(piece)
            return model.tokenize(piece)

    mine.model, mine.whole = Model(), lambda text: wholes.append(text) or b""
    text = "Éa\n" + " ".join(["wordy wordy. wordy, wordy!! wordy.,!? éa éa### éa$$$ éa##"] * 3)
    got = mine.ids(text)
    assert wholes == []  # was once for each word with a run of marks
    assert len(asked) == len(set(asked)) == 11  # four spellings of words (a space or none before them), seven runs
    assert np.frombuffer(got, "<u4").tolist() == want.encode(text, add_special_tokens=False).ids


def test_runs_of_marks_against_the_library():
    mine, want = packing.Tokens(queries.TOKENIZER), Tokenizer.from_file(queries.TOKENIZER)
    runs = [a + b + c for a in packing.MARKS + "<|>" for b in ["", *packing.MARKS, "<", "|", ">"] for c in ("", "'", "s", "'s", "1", "é", "…")]
    for word in ("on", "Déjà", "中"):
        for text in (" ".join(word + r for r in runs), "\n".join(word + r for r in runs), " ".join(r + word for r in runs)):
            assert np.frombuffer(mine.ids(text), "<u4").tolist() == want.encode(text, add_special_tokens=False).ids
