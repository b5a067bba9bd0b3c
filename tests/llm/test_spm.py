import random
import struct

import numpy as np
import pytest
import sentencepiece

from actweave.llm import spm

SF = "/root/testdata/sf0.001"
EDGES = [None, "", " ", "   ", "a  b", " a", "x   ", "\n\nx\ty", "ﬁ Å é", "\xa0x　y", "😀 🇮🇹 ok", "<s>x</s>", "▁a ▁ b", "a\x00b", "<0x41>", "a" * 3000, " " * 200 + "z", " " * 20_001 + "end", "ab" * 20_000, "  é " * 5, "日本語テキスト 梦想", "͸͹"]


@pytest.fixture(scope="module")
def vocabulary():
    return spm.Vocabulary.read()


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=spm.MODEL)


def test_edges_as_the_library_has_them(vocabulary, library):
    for t in EDGES:
        ids = vocabulary.encode(t)
        assert ids == (library.encode(t) if t else []), repr(t)
        assert vocabulary.decode(ids) == library.decode(ids)
        assert vocabulary.decode(ids) == (t or "").replace("▁", " ")


def test_random_texts(vocabulary, library):
    rng = random.Random(1)
    for chars in ("ab c", "the of an d\n.,", "etaoin shrdlu", "aAéßñ12 .", "▁ab  "):
        for _ in range(300):
            t = "".join(rng.choice(chars) for _ in range(rng.randrange(1, 40)))
            assert vocabulary.encode(t) == library.encode(t), repr(t)


def test_unigram_model_takes_the_best_sum():
    v = spm.Vocabulary(["<unk>", "▁", "a", "b", "ab", "▁a", "ba"], [0, -1.5, -1.2, -1.2, -2.1, -2.0, -0.3], [], frozenset([0]), 0, False)
    assert v.encode("ab") == [5, 3]  # ▁a b: -3.2; ▁ ab: -3.6
    assert v.encode("aba") == [5, 6] and v.decode(v.encode("aba")) == "aba"
    assert v.encode("aza") == [5, 0, 2]


def test_documents(spark, vocabulary, library):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    got = {r.doc_id: r for r in spm.encoded(docs, vocabulary).collect()}
    assert len(got) == docs.count()
    for r in got.values():
        assert r.pieces == library.encode(r.text)
    back = {r.doc_id: r.text for r in spm.decoded(spm.encoded(docs, vocabulary), vocabulary).collect()}
    assert back == {k: r.text for k, r in got.items()}
    assert all(r.round_trip and r.n_pieces == len(got[r.doc_id].pieces) for r in spm.digests(docs, vocabulary).collect())


def test_table_edges(spark, vocabulary):
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate(EDGES)] + [(None, "a", "y"), (1, "", "z")], "doc_id long, text string, pieces string")
    got = spm.digests(df, vocabulary).collect()
    assert len(got) == len(EDGES) + 2 and all(r.round_trip for r in got)
    assert spm.encoded(df.limit(0), vocabulary).count() == 0
    assert dict(spm.encoded(df, vocabulary).dtypes)["pieces"] == "array<int>"


def test_long_runs_of_symbols_behind_spaces(vocabulary, library):
    for run in ("-", "*", ".", "~", "=", "_", "#", "-=", ". ", "a", "ab", "9"):
        for n in (30, 61, 62, 63, 64, 65, 80, 200, 1001):
            for spaces in (1, 2, 3, 4, 7, 15, 16, 17, 20):
                for t in (" " * spaces + run * n, "x" + " " * spaces + run * n + " y"):
                    assert vocabulary.encode(t) == library.encode(t), (run, n, spaces)


def test_many_at_once_and_one_by_one_agree(vocabulary):
    rng = random.Random(5)
    words = ["".join(rng.choice("etaoinshrdluéß.,-\n0123") for _ in range(rng.choice((1, 3, 9, 30, 127, 128, 129, 300)))) for _ in range(400)]
    many = spm.Vocabulary.read()
    many.learn(list(dict.fromkeys(words)))
    for w in words:
        own = []
        kind = vocabulary._starts(np.array([ord(c) for c in spm.MARK + w]))
        heads = sorted(set(kind.tolist()))
        for a, b in zip(heads, [*heads[1:], len(w) + 1], strict=True):
            own += vocabulary.segment((spm.MARK + w)[a:b])
        assert list(struct.unpack(f"<{len(own)}I", many.seen[w])) == own


def test_unigram_at_once_and_one_by_one_agree():
    rng = random.Random(6)
    pieces = ["<unk>", "▁", *{"".join(rng.choice("abc") for _ in range(rng.randrange(1, 5))) for _ in range(40)}, "▁a", "▁ab"]
    pieces = list(dict.fromkeys(pieces))
    v = spm.Vocabulary(pieces, [0.0, *(-rng.random() * 9 for _ in pieces[1:])], [], frozenset([0]), 0, False)
    for _ in range(300):
        w = "".join(rng.choice("abcd") for _ in range(rng.randrange(1, 40)))
        best = {0: 0.0}
        for k in range(1, len(w) + 2):
            text = spm.MARK + w
            options = [best[k - len(p)] + v.scores[i] for i, p in enumerate(pieces) if i and text[:k].endswith(p) and k - len(p) in best]
            best[k] = max(options) if options or text[k - 1] in v.ids else best[k - 1] + v.low
        got = v.encode(w)
        assert abs(sum(v.scores[i] if i else v.low for i in got) - best[len(w) + 1]) < 1e-6


def test_memory_turns_over(vocabulary, library, monkeypatch):
    monkeypatch.setattr(spm, "REMEMBERED", 50)
    v, rng = spm.Vocabulary.read(), random.Random(8)
    for _ in range(40):
        texts = [" ".join("".join(rng.choice("aeinst") for _ in range(rng.randrange(1, 5))) for _ in range(30)) for _ in range(3)]
        for t, c in zip(texts, v.encode_texts(texts), strict=True):
            assert list(struct.unpack(f"<{len(c) // 4}I", c)) == library.encode(t)
    monkeypatch.setattr(spm, "AT_ONCE", 64)
    for t in ("ab" * 300 + "é\n" * 50, "x\ny" * 200, "日本語" * 90):
        assert v.encode(t) == library.encode(t)
