"""ids of cached chunks against the library, over all letters and digits before marks."""

import string
import sys

import public_tokenizers
import pytest
from tokenizers import Tokenizer

from skeinwork.llm.tokens import Encoder

MARKS = [m for m in string.punctuation]


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "byte_bpe_50k.json"])
def test_letters_before_marks(name):
    path = public_tokenizers.path(name)
    library, ours = Tokenizer.from_file(path), Encoder(path)
    letters = [c for c in map(chr, range(sys.maxunicode + 1)) if c.isalnum()]
    joined = [c for c in letters if not ours._ends_word(c)]
    texts = ["".join(f"x a{c}, {c}. b " for c in letters[at : at + 50]) for at in range(0, len(letters), 50)]
    texts += ["".join(f"x a{c}{m}b {c}{m} y" for m in MARKS) for c in [*joined, *letters[:: max(1, len(letters) // 500)]]]
    texts += ["a İ, b", "x İ. y", "x Aİ! y", "क़?", "q שׁ! z"]
    wanted = [e.ids for e in library.encode_batch_fast(texts, add_special_tokens=False)]
    got = [list(memoryview(b).cast("I")) for b in ours.encode(texts)]
    assert [t for t, a, b in zip(texts, wanted, got) if a != b] == []
    assert bool(joined) == (library.normalizer is not None)
