"""New words are learned many at a time, with the library's ids."""

import public_tokenizers
from tokenizers import Tokenizer

from skeinwork.llm.tokens import Encoder


class Counting:
    def __init__(self, normal):
        self.normal, self.calls = normal, 0

    def normalize_str(self, text):
        self.calls += 1
        return self.normal.normalize_str(text)


def test_normal_forms_by_the_thousand():
    path = public_tokenizers.path("word_bpe_49k.json")
    library, ours = Tokenizer.from_file(path), Encoder(path)
    ours.normal = Counting(ours.normal)
    words = [f"{a}{b}{c}" for a in "ÄßİΣé각ｋǅ" for b in "aΣ́שK" for c in "xÉς글."]
    text = "x " + " ".join(words) + ", y"
    assert list(memoryview(ours.encode([text])[0]).cast("I")) == library.encode(text, add_special_tokens=False).ids
    assert ours.normal.calls < 30
