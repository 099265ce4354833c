"""Words of plain letters go to the model of the tokenizers library at once."""

import random

import numpy as np

from veldmark.llm import common, tokens

BOTH = (("byte_bpe_50k.json", True), ("word_bpe_49k.json", False))


def test_plain_words_by_the_model_equal_the_library(monkeypatch):
    for name, leading in BOTH:
        cache = tokens.WordCache(common.default_path(name), leading)
        assert cache.direct
        words = ["Straße", "naïve", "ÉTÉ", "ÿ", "ß", "I", "don", "x" * 300, "Ångström", "anatthfüreinäß"]
        texts = [" ".join(words[i:] + words[:i]) for i in range(len(words))] + ["á été", "É́ x"]
        assert cache.encode(texts) == [np.array(e.ids, "<u4").tobytes() for e in cache.tokenizer.encode_batch(texts, add_special_tokens=False)]


def test_a_cache_with_one_dictionary_keeps_as_many_words_as_its_limit():
    cache = tokens.WordCache(common.default_path("word_bpe_49k.json"), False, limit=10)
    cache.encode(["alpha beta gamma delta epsilon zeta eta"])
    cache.encode(["alpha"])
    assert len(cache.first) == 7  # counted twice, these were more than 10


def test_merges_of_many_words_equal_the_library():
    rnd = random.Random(5)
    letters = "etaonihsrdluETAäöéßÀÿ"
    words = ["".join(rnd.choices(letters[: rnd.choice([2, 8, 21])], k=rnd.randint(1, 31))) for _ in range(3000)]
    for name, leading in BOTH:
        cache = tokens.WordCache(common.default_path(name), leading)
        for prefix in ["", " "][: 1 + leading]:
            found = {}
            cache._encode_direct(words, found, prefix)
            size, _ = cache.merges.encode([w.lower() for w in words] if cache.lower else words, bool(prefix))
            whole = [e.ids for e in cache.tokenizer.encode_batch([prefix + w for w in words], add_special_tokens=False)]
            assert size.tolist() == list(map(len, whole))
            assert [found[w] for w in words] == [np.array(i, "<u4").tobytes() for i in whole]


def test_words_met_again_outlive_the_limit(monkeypatch):
    for name, leading in BOTH:
        cache, seen = tokens.WordCache(common.default_path(name), leading, limit=10), []
        for text in ["x alpha b c d e f g h", "x alpha", "x i j k l", "x alpha b"]:
            monkeypatch.setattr(cache, "_encode_new", lambda new, known, prefix, own=tokens.WordCache._encode_new: seen.extend(new) or own(cache, new, known, prefix))
            assert cache.encode([text]) == [np.array(cache.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()]
        assert seen.count("alpha") == 1 and seen.count("b") == 2
