import hashlib
import json
import unicodedata

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from duecall.llm import bpe

tokenizers = pytest.importorskip("tokenizers")
P = pytest.importorskip("public_tokenizers")
OURS = bpe.Bpe(bpe.vocabulary())
THEIRS = tokenizers.Tokenizer.from_file(P.path("word_bpe_49k.json"))
PIECES = st.sampled_from(["a", "Hello", "ΣΑΣ", "İ", "it's", "'re", "42", "½", "!?.", "\x1c", "\u0085", "　", "\n\t ", "中文", "😀🏽", "é", "<|endoftext|>", "<|startoftext|>", "\x00", "ﬁ", "aaaaaaa"])


@settings(deadline=None, max_examples=300)
@given(st.lists(st.one_of(PIECES, st.text(max_size=6)), max_size=12).map("".join))
def test_as_the_library(text):
    text = text.encode("utf-8", "ignore").decode()
    want = THEIRS.encode(text, add_special_tokens=False).ids
    (got,) = OURS.encode([text])
    assert got.tolist() == want
    assert OURS.decode(got).decode() == THEIRS.decode(want, skip_special_tokens=False)


@pytest.mark.parametrize("context", ["{}", ":{}", "a{}b"])
def test_every_code_point(context):
    points = [chr(c) for c in [*range(0xD800), *range(0xE000, 0x110000)]]
    for at in range(0, len(points), 50_000):
        text = " ".join(context.format(c) for c in points[at : at + 50_000])
        assert OURS.encode([text])[0].tolist() == THEIRS.encode(text, add_special_tokens=False).ids, hex(ord(points[at]))


def test_newer_signs_compose_as_in_the_library():
    newer = [chr(c) for c in range(0x20000) if unicodedata.category(chr(c)) == "Cn"][:40_000]
    text = " ".join(x + y for x, y in zip(newer, newer[1:] + ["\u0307"], strict=True)) + " \U000105d2\u0307 a\u0897\u0301\u0323 \U00016d67\U00016d67"
    assert OURS.encode([text])[0].tolist() == THEIRS.encode(text, add_special_tokens=False).ids


def test_texts_are_cut_at_blanks_only(monkeypatch):
    monkeypatch.setattr(bpe, "AT_ONCE", 7)
    texts = ["one two  three <|endoftext|> four-teen it's a <|endoftext|>", "x" * 50, "", " \u3000 ", "a\x1cb \u0085 c" * 9]
    for text, got in zip(texts, bpe.Bpe(bpe.vocabulary()).encode(texts), strict=True):
        assert got.tolist() == THEIRS.encode(text, add_special_tokens=False).ids


def test_long_words_and_forgetting(monkeypatch):
    monkeypatch.setattr(bpe, "KEPT_BYTES", 3)
    monkeypatch.setattr(bpe, "AT_ONCE", 100)
    own = bpe.Bpe(bpe.vocabulary())
    for text in ("a" * 3000, "ab" * 2000, "one two three four five six", "one two three four five six"):
        assert own.encode([text])[0].tolist() == THEIRS.encode(text, add_special_tokens=False).ids


def test_merges_whose_ranks_fall():
    """A vocabulary in which a merge makes a pair of lower rank: one merge at a time, leftmost first."""
    letters = {x: k for k, x in enumerate([*bpe.byte_letters(), *(x + "</w>" for x in bpe.byte_letters())])}
    vocab = letters | {"abc</w>": 900, "ab": 901}
    spec = {"added_tokens": [], "pre_tokenizer": {"pretokenizers": [{"type": "Split", "pattern": {"Regex": r"[^\s]+"}}]}, "model": {"vocab": vocab, "end_of_word_suffix": "</w>", "merges": [["ab", "c</w>"], ["a", "b"]]}}
    own = bpe.Bpe(json.dumps(spec))
    assert not own.rising
    assert own.encode(["ababc abc"])[0].tolist() == [901, 900, 900]


def test_columns(spark):
    df = spark.createDataFrame([(1, "Hello <|endoftext|> world", 5), (2, None, 5), (3, "", 5), (1, "Hello <|endoftext|> world", 5)], "doc_id long, text string, ids int")
    got = bpe.tokenised(df).collect()
    ids = THEIRS.encode("Hello <|endoftext|> world", add_special_tokens=False).ids
    raw = b"".join(x.to_bytes(4, "little") for x in ids)
    for r in got:
        if r.doc_id == 1:
            assert (r.n_tokens, bytes(r.ids), r.ids_sha256) == (len(ids), raw, hashlib.sha256(raw).hexdigest())
            assert r.decoded_sha256 == hashlib.sha256(THEIRS.decode(ids, skip_special_tokens=False).encode()).hexdigest()
        else:
            assert (r.n_tokens, bytes(r.ids), r.decoded_sha256) == (0, b"", hashlib.sha256(b"").hexdigest())
    back = {r.doc_id: r.text for r in bpe.decode(bpe.encode(df)).collect()}
    assert back == {1: "hello</w> <|endoftext|> world</w>", 2: "", 3: ""}
    assert bpe.tokenised(df.limit(0)).count() == 0


def test_very_long_text_and_other_files():
    text = "Some words of a text, 42 times! " * 40_000
    assert OURS.encode([text])[0].tolist() == THEIRS.encode(text, add_special_tokens=False).ids
    spec = json.loads(bpe.vocabulary())
    spec["normalizer"]["normalizers"].pop()
    with pytest.raises(ValueError):
        bpe.Bpe(json.dumps(spec))
