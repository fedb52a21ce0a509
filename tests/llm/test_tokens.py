import numpy as np
import pytest

from sparkrecall.llm import tokens

ODD = [
    "", "  ", "Hello, World! it's I'LL don't 12 3½ ²x", "a\x1cb c\x1d d  éÉ İstanbul ß ﬁ", "<|endoftext|>x <|startoftext|>y", "naïve 日本語 é é 🙂🙂 x\x00y \x85 z\xa0q",
    "ñandú—word… “quoted”", "x" * 200 + " " + "é" * 100, "a​b c　d", "Σίσυφος ΣΑΣ Dž", "###%%%&&& *** |a|b|", "µ × ÷ ÀÖØöøÿ ªº", "tab\tnew\nline\r\x0b\x0c", "'s 'sx x's 'RE'LL",
]


@pytest.fixture(scope="module")
def code():
    return tokens.Encoder(tokens.tokenizer_path())


@pytest.mark.parametrize("text", ODD)
def test_same_as_whole_text(code, text):
    want = code.tokenizer.encode(text, add_special_tokens=False)
    assert np.frombuffer(code.ids(text), "<u4").tolist() == want.ids
    assert [tuple(x) for x in code.spans([text, text])[1].tolist()] == want.offsets
    assert np.frombuffer(code.ids(text), "<u4").tolist() == want.ids  # from what is known by now


def test_cache_is_bounded(code, monkeypatch):
    monkeypatch.setattr(tokens, "CACHE_WORDS", 5)
    monkeypatch.setattr(tokens, "CACHE_PARTS", 5)
    for k in range(40):
        text = f"word{k} other{k} Third{k}é"
        assert np.frombuffer(code.ids(text), "<u4").tolist() == code.tokenizer.encode(text, add_special_tokens=False).ids
    assert len(code.known) <= 5 + 3


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "byte_bpe_50k.json"])
def test_every_tokenizer(name, monkeypatch):
    """Whole, in one call, and in parts: the ids and spans of encode, for the word BPE and for another."""
    code = tokens.Encoder(tokens.tokenizer_path(name))
    assert code.by_word == (name == "word_bpe_49k.json")
    every = [*ODD, "Hello World, it's A test\n  of spacing.", "  lead and  double  spaces , odd\u0301 marks \u0301 x " * 30]
    every.append(" ".join(every) * 3)
    want = [code.tokenizer.encode(t, add_special_tokens=False) for t in every]
    for most in (1 << 30, 40, 7):
        monkeypatch.setattr(tokens, "PART_CHARS", most)
        code.most = most
        assert [np.frombuffer(code.ids(t), "<u4").tolist() for t in every] == [w.ids for w in want]
        assert [[tuple(x) for x in s.tolist()] for s in code.spans(every)] == [w.offsets for w in want]


def test_unknown_steps_are_encoded_whole(tmp_path):
    """A tokenizer whose steps are not known gets whole texts, never words or parts."""
    from tokenizers import normalizers

    code = tokens.Encoder(tokens.tokenizer_path())
    code.tokenizer.normalizer = normalizers.Sequence([normalizers.NFC()])
    code.tokenizer.save(str(tmp_path / "other.json"))
    other = tokens.Encoder(str(tmp_path / "other.json"))
    assert not other.by_word and other.most is None
    for t in ODD:
        assert np.frombuffer(other.ids(t), "<u4").tolist() == other.tokenizer.encode(t, add_special_tokens=False).ids


LONG = {
    "cyrillic": "Слово за словом, и снова «ЁЛКА» без конца; ΟΔΥΣΣΕΥΣ ΚΑΙ. ",
    "chinese": "这是没有空格的文字。第二句，还有第三句！数字12和abc；",
    "mixed": "naïve e\u0301le\u0301ve  l'été 'tis  x_1 a\tb\nЖ 字 한국어 텍스트 ",
    "bare": "безпробелов日本語",
}


@pytest.mark.parametrize("name", sorted(LONG))
@pytest.mark.parametrize("file", ["word_bpe_49k.json", "byte_bpe_50k.json"])
def test_long_texts_of_any_alphabet_in_parts(monkeypatch, name, file):
    """Cut or not, ids and spans are those of the whole text; only a text with no place to cut stays whole."""
    monkeypatch.setattr(tokens, "PART_CHARS", 200)
    code, text = tokens.Encoder(tokens.tokenizer_path(file)), LONG[name] * 60
    pieces = [p for _, p in tokens.parts(text, 200)]
    assert "".join(pieces) == text and (max(map(len, pieces)) < 300 if name != "bare" else len(pieces) == 1)
    whole = code.tokenizer.encode(text, add_special_tokens=False)
    assert np.frombuffer(code.ids(text), "<u4").tolist() == whole.ids
    assert list(map(tuple, code.spans([text])[0].tolist())) == whole.offsets
