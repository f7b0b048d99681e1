"""Token ids of texts that hold special tokens against the library as it is."""

from __future__ import annotations

import random
import zlib

import numpy as np
import pytest
from tokenizers import Tokenizer

from factledger.llm import packing, records, tokens
from factledger.llm.queries import tokenizer
from test_operators import BYTE, WORD, table

TEXTS = [
    "one <|endoftext|> two", "<|endoftext|>", "<|startoftext|><|endoftext|>x", "a<|ENDOFTEXT|>b", "<|endoftext| >",
    "é <|endoftext|> 漢", "plain words only", "<<|endoftext|>>", None, "",
]


@pytest.mark.parametrize("name", [BYTE, WORD])
def test_special_tokens_are_those_of_the_library(name):
    model, encode, rng = Tokenizer.from_file(tokenizer(name)), tokens.encoder(tokenizer(name)), random.Random(name)
    parts = ["<|endoftext|>", "<|startoftext|>", "<|", "|>", " ", "a", "é", "漢", "endoftext", "\n", "7"]
    texts = [t or "" for t in TEXTS] + ["".join(rng.choices(parts, k=rng.randrange(12))) for _ in range(500)]
    got = [np.frombuffer(b, encode.dtype).tolist() for b in encode.encode(texts)]
    assert got == [model.encode(t, add_special_tokens=False).ids for t in texts]


def test_records_and_pieces_of_special_tokens(spark):
    docs = table(spark, TEXTS)
    model = Tokenizer.from_file(tokenizer(BYTE))
    coded = [np.array([*model.encode(t or "", add_special_tokens=False).ids, 0], "<u4") for t in TEXTS]
    found = records.record_digests(records.write_records(docs, tokenizer(BYTE)), tokenizer(BYTE)).collect()
    starts = np.cumsum([0, *map(len, coded)]).tolist()
    want = [(k, starts[k], len(c), zlib.crc32(c.tobytes())) for k, c in enumerate(coded)]
    assert sorted(map(tuple, found)) == want
    model = Tokenizer.from_file(tokenizer(WORD))
    n = {k: len(model.encode(t or "", add_special_tokens=False).ids) + 1 for k, t in enumerate(TEXTS)}
    assert {r["doc_id"]: r["doc_tokens"] for r in packing.pieces(docs, tokenizer(WORD)).collect()} == n


@pytest.mark.parametrize("name", [BYTE, WORD])
def test_new_words_go_to_the_merges_alone(name):
    encode, whole = tokens.Encoder(tokenizer(name), special_as_text=False), Tokenizer.from_file(tokenizer(name))
    asked = []

    class Library:
        def encode_batch_fast(self, texts, **options):
            asked.extend(texts)
            return whole.encode_batch_fast(texts, **options)

    encode.model = Library()
    letters = [chr(c) for c in range(256) if chr(c).isalpha()]
    rng = random.Random(name)
    texts = ["start " + " ".join("".join(rng.choices(letters, k=rng.randrange(1, 9))) for _ in range(300)) for _ in range(20)]
    got = [np.frombuffer(b, encode.dtype).tolist() for b in encode.encode(texts)]
    assert sum(map(len, asked)) < 10  # no word but the texts' first, which has no space before it
    assert got == [whole.encode(t, add_special_tokens=False).ids for t in texts]
