"""Packing's ids of texts with very long runs of white space, against the library of the vocabulary's own file."""

import numpy as np
import public_tokenizers as P
import pytest
from tokenizers import Tokenizer

from linkfold.llm import packing


@pytest.mark.parametrize("blank", [" ", "\n", " \t", "\u3000"])
def test_two_million_blanks(docs, blank):
    own = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    text = "ab <|endoftext|> c" + blank * (2_000_000 // len(blank)) + "d"
    found = packing.pieces(docs([text, "ab"]), P.path("byte_bpe_50k.tiktoken"), P.PATTERN, {"<|endoftext|>": 50256}, 2, 1024)
    got = {0: [], 1: []}
    for r in found.orderBy("doc_id", "piece").collect():
        got[r["doc_id"]].append(np.frombuffer(r["ids"], "<u4"))
    assert np.concatenate(got[0]).tolist() == [*own.encode(text, add_special_tokens=False).ids, 2]
    assert np.concatenate(got[1]).tolist() == [*own.encode("ab", add_special_tokens=False).ids, 2]
