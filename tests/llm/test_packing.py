import random
from collections import defaultdict
from itertools import product

import numpy as np
import pytest

from rillgrid.llm import packing

public_tokenizers = pytest.importorskip("public_tokenizers")
PATH = public_tokenizers.path("word_bpe_49k.json")


def ids(text):
    return packing._tokenizer(PATH)[0].encode(text or "", add_special_tokens=False).ids


def test_best_fill_against_all_choices():
    rng = random.Random(3)
    for _ in range(200):
        counts = {rng.randint(1, 30): rng.randint(1, 3) for _ in range(rng.randint(1, 5))}
        capacity = rng.randint(1, 60)
        best = max(s for c in product(*[range(n + 1) for n in counts.values()]) if (s := sum(k * x for k, x in zip(counts, c, strict=True))) <= capacity)
        got = packing.best_fill(counts, capacity)
        assert sum(k * n for k, n in got.items()) == best
        assert all(n <= counts[k] for k, n in got.items())


def test_encoding_is_the_tokenizer_s():
    rng = random.Random(2)
    letters = "aÀÉßçñ'’ºªµ.,!? \n\t\x0b\x85\xa0 ΣσİKéxyz0१²…<|endoftext|>'s'LLsT\x1c日本"
    texts = ["".join(rng.choice(letters) for _ in range(rng.randint(0, 60))) for _ in range(500)]
    for text in [*texts, "<|endoftext|> a <|ENDOFTEXT|>", "it's, we'll. x'S.", "", "  ", "a.,b . c ,d,e\n."]:
        assert np.frombuffer(packing.encode(PATH, text), dtype="<u4").tolist() == ids(text)


def test_every_id_lies_in_one_piece(documents, rows, nothing):
    got = packing.pack(documents, PATH, window=64).collect()
    sequences, pieces = defaultdict(list), defaultdict(list)
    for r in got:
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
        part = np.frombuffer(bytes(r["ids"]), dtype="<u4").tolist()
        assert len(part) == r["length"] > 0
        pieces[r["doc_id"], r["doc_tokens"]].append((r["start"], part))
    for parts in sequences.values():
        end = 0
        for offset, length in sorted(parts):
            assert offset == end
            end += length
        assert end == 64 or (end < 64 and end & (end - 1) == 0)
    want = defaultdict(list)
    for r in rows:
        whole = [*ids(r[1]), 2]
        want[r[0], len(whole)].append(whole)
    assert pieces.keys() == want.keys()
    for key, wholes in want.items():
        got_ids = sorted(x for _, part in pieces[key] for x in part)
        assert got_ids == sorted(x for whole in wholes for x in whole)
        if len(wholes) == 1:
            assert [x for _, part in sorted(pieces[key]) for x in part] == wholes[0]
    assert packing.pack(nothing, PATH).count() == 0
