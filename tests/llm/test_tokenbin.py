import random
import zlib

import numpy as np
import pytest
from ledgerloom.llm import tokenbin
from ledgerloom.llm.queries import tokenizer_path
from ledgerloom.sources.scratch import new_path
from tokenizers import Tokenizer

PATH = tokenizer_path("byte_bpe_50k.json")
PARTS = ["a", "Be", "é", " ", "  ", "\n", "\t", "\r\n", "\x85", "\xa0", " ", "　", "'s", "'", "1", "23", "!", "\x1c", "\x00", "日本", "́", "<|endoftext|>", "I'll", "​", "𝒳", ",", ".", "word"]


def texts(n):
    rnd = random.Random(2)
    return ["".join(rnd.choice(PARTS) for _ in range(rnd.randrange(14))) for _ in range(n)]


@pytest.mark.parametrize("remembered", [5, 500_000])
def test_pieces_give_the_ids_of_whole_texts(remembered):
    enc, plain = tokenbin.Encoder(PATH, remembered), Tokenizer.from_file(PATH)
    all_texts = texts(2_000)
    for t, got in zip(all_texts, enc.encode(all_texts), strict=True):
        assert np.frombuffer(got, enc.dtype).tolist() == plain.encode(t, add_special_tokens=False).ids, t


def test_store_against_brute_force(spark):
    rows = [(i * 3, t) for i, t in enumerate(texts(300))] + [(5, None), (7, "many words " * 20_000), (9, "same"), (9, "same"), (9, "other"), (None, "none")]
    random.Random(0).shuffle(rows)
    df = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, start string")
    path = new_path(spark, "store")
    tokenbin.write_store(df, path, PATH, segment_bytes=2_000)
    plain = Tokenizer.from_file(PATH)
    made = [(d, [*plain.encode(t or "", add_special_tokens=False).ids, 2]) for d, t in rows]
    got = sorted((tuple(r) for r in tokenbin.read_documents(spark, path).collect()), key=lambda r: r[1])
    assert [r[0] if r[0] is not None else -1 for r in got] == sorted(d if d is not None else -1 for d, _ in rows)
    at = 0
    for _, start, n, _ in got:
        assert start == at
        at += n
    crc = lambda ids: zlib.crc32(np.array(ids, "<u4").tobytes())
    assert sorted((d or -1, n, c) for d, _, n, c in got) == sorted((d or -1, len(ids), crc(ids)) for d, ids in made)
    assert sorted(x.tolist() for x in tokenbin.lookup(spark, path, 9)) == sorted(ids for d, ids in made if d == 9)
    assert tokenbin.lookup(spark, path, 4) == []
    assert spark.read.parquet(f"{path}/segments").count() > 3
    blob = bytes(spark.read.parquet(f"{path}/segments").first()["blob"])
    with pytest.raises(ValueError, match="dictionary"):
        tokenbin.Segment(blob, b"another")


def test_empty_table(spark):
    path = new_path(spark, "store")
    tokenbin.write_store(spark.createDataFrame([], "doc_id long, text string"), path, PATH)
    assert tokenbin.read_documents(spark, path).count() == 0
