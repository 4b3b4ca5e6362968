import hashlib
import random

import numpy as np
import pytest
from quillon.llm.bpe import bpe_encode, default_path, word_bpe
from tokenizers import Tokenizer


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(default_path())


def expect(library, text):
    ids = library.encode(text or "", add_special_tokens=False).ids
    return len(ids), hashlib.sha256(np.array(ids, dtype="<u4").tobytes()).hexdigest(), hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()


def texts():
    rng = random.Random(3)
    pool = [chr(c) for r in (range(1, 0x250), range(0x300, 0x600), range(0x1E00, 0x2100), range(0x4E00, 0x4E40), range(0xAC00, 0xAC20)) for c in r]
    pool += [chr(c) for c in (0x3000, 0x1F600, 0x1D400, 0x200B, 0xFEFF, 0x180E, 0x1C89)]
    odd = ["".join(rng.choice(pool) for _ in range(120)) for _ in range(400)]
    return odd + [None, "", "  ", "<|endoftext|>a<|startoftext|>  B <|x|>'S I'LL don't 12345 ΑΣ Σ ß İ", "a" * 999, "!!??..,," * 99, "\x1ca\x1fb", "the the <|endoftext|>"]


def test_like_the_library(spark, library):
    rows = [(i, t) for i, t in enumerate(texts())] + [(5, "twice"), (5, "twice")]
    rows += [(1000 + r.doc_id, r.text) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()]
    df = spark.createDataFrame([(i, t, 0) for i, t in rows], "doc_id long, text string, ids int")
    got = sorted(map(tuple, bpe_encode(df).collect()))
    assert got == sorted((i, *expect(library, t)) for i, t in rows)
    assert bpe_encode(df.limit(0)).count() == 0


def test_borders(library):
    """Neighbours are compatible exactly where merging the joined letters gives the two again."""
    bpe, rng = word_bpe(default_path()), np.random.default_rng(1)
    inner = np.array([i for t, i in bpe.vocab.items() if not t.endswith(bpe.suffix) and i in bpe.sound])
    ended = np.array([i for t, i in bpe.vocab.items() if t.endswith(bpe.suffix) and i in bpe.sound])
    left, right = rng.choice(inner, 4000), rng.choice(ended, 4000)
    words = [bpe.name[a] + bpe.name[b].removesuffix(bpe.suffix) for a, b in zip(left.tolist(), right.tolist())]
    want = [ids == [a, b] for ids, a, b in zip(bpe.merged(words), left.tolist(), right.tolist())]
    assert bpe.borders_hold(left, right).tolist() == want and 0 < sum(want) < 4000


def test_ids_and_decode(spark, library):
    r = bpe_encode(spark.createDataFrame([(1, "Hello, World")], "doc_id long, text string"), with_ids=True).first()
    assert r.ids == library.encode("Hello, World", add_special_tokens=False).ids and r.decoded == word_bpe(default_path()).decode(np.array(r.ids))
