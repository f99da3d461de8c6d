"""Findings of FINDINGS_r02 on the training-data operators: each test fails on the code before."""

import base64
import random
import sys

import numpy as np
import pyarrow as pa

from gridloom.llm import bpe, packing


def calls(run) -> int:
    """Python and library calls that run() makes from Python."""
    n = 0

    def count(_, event, __):
        nonlocal n
        n += event in ("call", "c_call")

    sys.setprofile(count)
    try:
        run()
    finally:
        sys.setprofile(None)
    return n


def words(seed: int, n: int) -> list[str]:
    rng = random.Random(seed)
    return ["".join(rng.choice(("th", "on", "er", "Éa", "ing", "q", "7")) for _ in range(rng.randint(1, 7))) + rng.choice(("", "", ",", ".", "!?")) for _ in range(n)]


def test_packing_tokenises_by_columns():
    """op10: distinct chunks are encoded together, without calls for each; the ids are the library's, also of rows apart."""
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    lib, tok = Tokenizer.from_file(path), packing.WordTokenizer(path)
    texts = [" ".join(words(k, 400)) for k in range(10)] + ["", " \n\t ", "it's  İ 日 don't\x0bx\x00y Ünï", "a" * 3000, "12,3"]
    ids = []
    assert calls(lambda: ids.extend(tok.encode(texts))) < len(set(" ".join(texts).split()))
    assert [np.frombuffer(x, "<u4").tolist() for x in ids] == [lib.encode(t, add_special_tokens=False).ids for t in texts]
    assert tok.encode(pa.array(texts).slice(3, 9)) == ids[3:12] and tok.encode([]) == [] and tok.encode(["", ""]) == [b"", b""]


def test_bpe_splits_by_columns():
    """op9: segments are split and looked up together, without calls for each; the ids are the library's, also of rows apart."""
    import tiktoken

    path, pattern = bpe.vocabulary()
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(path, "rb"))}
    lib, c = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={}), bpe.Codec(ranks, pattern)
    texts = [" ".join(f"{w}{k}!" for w in words(1, 60)) for k in range(100)]
    texts += ["日", "", " ", "\n", "a \n\n b", "tail \n", "it's\x85 a\xa0b 3\xd74 ÷", "\t x", "é" * 9, " \u2003y \u3000z", "Ω ж ʰ ͅ \x1c"]
    want, ids = [np.array(lib.encode_ordinary(t), "<u4").tobytes() for t in texts], []
    assert list(c.encode_all(texts)) == want
    c.known.clear()
    c.older.clear()
    assert calls(lambda: ids.extend(c.encode_all(texts))) < len(set(" ".join(texts).split(" ")))
    assert ids == want and list(c.encode_all(pa.array(texts).slice(95, 9))) == want[95:104]
    assert list(c.encode_all([])) == [] and list(c.encode_all(["", ""])) == [b"", b""] and list(c.encode_all(["日"])) == want[100:101]
    assert list(c.encode_all(["é" * 700 + " x"])) == [np.array(lib.encode_ordinary("é" * 700 + " x"), "<u4").tobytes()]
    assert all("".join(c.decode(np.frombuffer(x, "<u4"), 3)) == t for t, x in zip(texts, ids))
