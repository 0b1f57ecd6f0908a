import itertools
import json
import random

import numpy as np
import pytest

from stopflow.llm.tokens import Encoder, tokenizer_path

NAMES = ["byte_bpe_50k.json", "word_bpe_49k.json"]
MARKS = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"


def whole(enc, texts):
    return [np.asarray(enc.tokenizer.encode(t, add_special_tokens=False).ids, "<u4").tobytes() for t in texts]


@pytest.mark.parametrize("name", NAMES)
def test_a_word_is_encoded_once_whatever_stands_behind_it(name):
    enc, given = Encoder(name), []
    together = enc._words
    enc._words = lambda words, before: given.extend(words) or together(words, before)
    words = ["".join(w) for w in itertools.product("abcdefgh", repeat=3)]
    text = "x " + " ".join(w + m for m in ("", ",", ".", "!!", "$$$") for w in words)
    assert enc.encode([text, text]) == whole(enc, [text, text])
    assert len(given) <= 5


def odd_texts(rng, n):
    odd = ["l'eau", "don't", "'s", "a'", "x2", "2x", "a_b", "\u0130stanbul", "\u01c6ungla", "\ufb01ne", "\u03a3\u0391\u03a3", "a\u0301", "\u0301a", "\u00b5m", "\u00aa", "a\u200db", "\x01"]
    letters = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ" * 3 + "".join(filter(str.isalpha, map(chr, range(128, 256))))
    for _ in range(n):
        text = ""
        for _ in range(rng.choice([0, 1, 4, 30])):
            text += rng.choice(odd) if rng.random() < 0.05 else "".join(rng.choices(letters, k=rng.randint(1, 8)))
            text += "".join(rng.choices(MARKS, k=rng.choice([0, 0, 1, 3]))) + rng.choice("    \n")
        yield text if rng.random() < 0.2 else text.rstrip()


@pytest.mark.parametrize("name", NAMES)
def test_words_and_punctuation_give_the_ids_of_whole_texts(name):
    enc, texts = Encoder(name, remembered=500), list(odd_texts(random.Random(8), 400))
    assert enc.letters
    want = whole(enc, texts)
    assert [ids for i in range(0, 400, 40) for ids in enc.encode(texts[i:i + 40])] == want and enc.encode([]) == []


@pytest.mark.parametrize("name", NAMES)
def test_a_tokenizer_that_knows_more_than_letters_is_given_all_words(name, tmp_path):
    """Here `the` is a token of its own wherever it stands."""
    with open(tokenizer_path(name)) as f:
        spec = json.load(f)
    last = max(t["id"] for t in spec["added_tokens"])
    spec["added_tokens"].append({"id": last + 1, "content": "the", "single_word": False, "lstrip": False, "rstrip": False, "normalized": False, "special": False})
    path = tmp_path / "own.json"
    path.write_text(json.dumps(spec))
    enc, texts = Encoder(str(path)), ["the other, mother the.", "a there\nthe"]
    assert enc.letters is None and enc.encode(texts) == whole(enc, texts)
