from hypothesis import given, settings
from hypothesis import strategies as st

from confuscope.llm.queries import tokenizer_path
from confuscope.llm.tokenization import encoder

FILES = ("byte_bpe_50k.json", "word_bpe_49k.json")


def whole(name, text):
    return encoder(tokenizer_path(name)).tokenizer.encode(text, add_special_tokens=False).ids


def test_same_ids_as_whole_texts(docs_rows):
    texts = [t for _, t in docs_rows] + ["\x1c a \x85b　 c", " a", "a ", "a  b", "\n a\n b \t c", "it's 've  's", "ΣΑΣ  Σ. ǅ", "á ́b", "᠎ ​ x", "a \0b", "\0", "\0 \0x", "a|b | c"]
    for name in FILES:
        enc = encoder(tokenizer_path(name))
        for t, ids in zip(texts, enc.encode(texts), strict=True):
            assert ids.tolist() == whole(name, t or "")


@settings(max_examples=150, deadline=None)
@given(st.lists(st.sampled_from(["a", "The", " ", "  ", "\n", "\t", " ", "́", "7", "'s", "<|endoftext|>", "é", "\x1d", "Σ", "!?", "東", "\0", "|", " | "]), max_size=14))
def test_same_ids_on_any_mixture(parts):
    text = "".join(parts)
    for name in FILES:
        assert encoder(tokenizer_path(name)).encode([text])[0].tolist() == whole(name, text)


def test_memo_starts_afresh(monkeypatch):
    from confuscope.llm import tokenization

    monkeypatch.setattr(tokenization, "MEMO", 3)
    enc = tokenization.ChunkEncoder(tokenizer_path(FILES[0]))
    texts = ["one two three four five", "six " + "y" * 100, None, ""]
    for _ in range(3):
        assert [x.tolist() for x in enc.encode(texts)] == [whole(FILES[0], t or "") for t in texts]
    assert len(enc.numbers) <= 3 + 8


def test_case_and_punctuation_share_a_word(monkeypatch):
    from confuscope.llm import tokenization

    enc = tokenization.ChunkEncoder(tokenizer_path(FILES[1]))
    ids, sent = enc._ids, []
    monkeypatch.setattr(enc, "_ids", lambda texts, *how: sent.extend(texts) or ids(texts, *how))
    texts = ["Shore shore, SHORE. (shore) shore!?\nÉté été; ÉTÉ", "shore's Shore's. dogs' 'S x' x'.", "№ Shore SHORE…  ÉTÉ."]
    found = enc.encode(texts[:1])
    words = " ".join(sent).split()
    assert words.count("shore") == words.count("été") == 1 and not {"shore,", "Shore", "SHORE.", "ÉTÉ"} & set(words)
    assert [x.tolist() for x in found + enc.encode(texts[1:])] == [whole(FILES[1], t) for t in texts]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from(["Ab", "H", "h", "̱", "́", "̸", "É", "ß", "İ", "Σ", "K", "²", "µ", "ª", "\xa0", "\xad", "\x85", "क़", "क़", "…", ".", "'", "s", "S", "<", "|", "7", " ", "\n", "</w>", "y" * 70]), max_size=14))
def test_same_ids_behind_words_and_punctuation(parts):
    text = "".join(parts)
    for name in FILES:
        assert encoder(tokenizer_path(name)).encode([text, text.lower(), text + "."])[0].tolist() == whole(name, text)
        assert encoder(tokenizer_path(name)).encode([text + ".,"])[0].tolist() == whole(name, text + ".,")
