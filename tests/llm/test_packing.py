import zlib
from collections import defaultdict

import numpy as np
import pytest

from docketmill.llm import packing

tokenizers = pytest.importorskip("tokenizers")
PATH = pytest.importorskip("public_tokenizers").path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def plain():
    tokenizer = tokenizers.Tokenizer.from_file(PATH)
    return lambda text: [*tokenizer.encode(text or "", add_special_tokens=False).ids, 2]


def test_encoder_gives_the_tokenizer_s_ids(awkward, plain, monkeypatch):
    texts = [r[1] for r in awkward] + ["it's <|endoftext|> Á x" + "y" * 9000, "a\r\nb　c\x1cd  e\n\n", "It'S I'LL don't 12 3.4!!!"]
    encoder = packing.Encoder(PATH, 2)
    for _ in range(2):
        assert [x.tolist() for x in encoder.encode(texts)] == [plain(t) for t in texts]
    monkeypatch.setattr(packing, "CHUNKS_KEPT", 7)
    assert [packing.Encoder(PATH, 2).encode([t])[0].tolist() for t in texts] == [plain(t) for t in texts]


def test_added_tokens_in_every_case_and_joined_to_anything(plain):
    import random

    rnd = random.Random(5)
    marks = ["<|endoftext|>", "<|startoftext|>", "<|ENDOFTEXT|>", "<|STARTOFTEXT|>", "<|EndOfText|>", "<|endoftext", "|>", "<|"]
    rest = ["a", "B", "É", "e\u0301", " ", "\n", "  ", "'s", "'S", "1", ".", "|", "<", "\u3000", "ſ", "İ"]
    texts = ["".join(rnd.choice(marks if rnd.random() < 0.4 else rest) for _ in range(rnd.randint(1, 12))) for _ in range(3000)]
    encoder = packing.Encoder(PATH, 2)
    assert encoder.cuts
    assert [x.tolist() for x in encoder.encode(texts)] == [plain(t) for t in texts]


def test_a_tokenizer_with_other_rules_encodes_whole_texts(awkward):
    path = pytest.importorskip("public_tokenizers").path("byte_bpe_50k.json")
    tokenizer, encoder = tokenizers.Tokenizer.from_file(path), packing.Encoder(path, 50256)
    texts = [r[1] for r in awkward] + ["It'S  <|endoftext|> A\n\n b <|ENDOFTEXT|>"]
    assert not encoder.cuts
    assert [x.tolist() for x in encoder.encode(texts)] == [[*tokenizer.encode(t or "", add_special_tokens=False).ids, 50256] for t in texts]


@pytest.mark.parametrize("size,fan", [(4096, 64), (64, 2)])
def test_every_id_once_and_no_padding(docs, awkward, plain, monkeypatch, size, fan):
    monkeypatch.setattr(packing, "FAN_IN", fan)
    rows = packing.pack(docs.repartition(5), PATH, size=size, most=4).collect()
    sequences, pieces = defaultdict(list), defaultdict(list)
    for r in rows:
        sequences[r.sequence_id].append(r)
        pieces[r.doc_id].append(r)
    total = 0
    for group in sequences.values():
        group.sort(key=lambda r: r.offset)
        assert [r.offset for r in group] == [0, *np.cumsum([r.length for r in group])[:-1]]
        used = sum(r.length for r in group)
        assert used == size or used < size and used & (used - 1) == 0
        assert {r.sequence_length for r in group} == {used}
        total += used
    assert total == sum(len(plain(r[1])) for r in awkward)
    assert sum(1 for g in sequences.values() if sum(r.length for r in g) < size) <= size.bit_length()
    by_doc = defaultdict(list)
    for r in awkward:
        by_doc[r[0]].append(plain(r[1]))
    for key, texts in by_doc.items():
        want = []
        ids = texts[0]
        assert {r.doc_tokens for r in pieces[key]} == {len(t) for t in texts}
        if len(texts) == 1:
            for r in sorted(pieces[key], key=lambda r: r.start):
                assert r.start == len(want)
                want += ids[r.start : r.start + r.length]
                assert r.ids_crc32 == zlib.crc32(np.array(ids[r.start : r.start + r.length], "<u4").tobytes())
            assert want == ids


def test_best_fit_and_bounded_windows():
    packer = packing.Packer(10, 2)
    ids = lambda n: np.arange(n, dtype=np.uint32)
    assert list(packer.place((1, 0, 6, ids(6)))) == []
    assert list(packer.place((2, 0, 5, ids(5)))) == []
    assert [w.used for w in packer.place((3, 0, 4, ids(4)))] == [10]
    assert sum(w.used for w in packer.place((4, 0, 9, ids(9)))) == 0
    done = list(packer.place((5, 0, 3, ids(3))))
    assert not done and len(packer.open) == 2
    assert [w.used for w in packer.place((6, 0, 8, ids(8)))] == [10] and len(packer.open) <= 2


def test_empty_table_and_clashing_columns(none, clashing):
    assert packing.pack(none, PATH).collect() == []
    assert len(packing.pack(clashing, PATH).collect()) >= 70
