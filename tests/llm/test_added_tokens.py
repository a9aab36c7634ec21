"""op8_packing and the pipeline's sequences beside `tokenizers` as it is, added tokens included."""

import random
import struct
import zlib

from tokenizers import Tokenizer

from corpusmill.llm import packing
from corpusmill.llm.queries import QUERIES

MARKS = ["<|endoftext|>", "<|endoftext|", "|>", " ", "  ", "\n", "a", " b", "don't", "'s", "é", " ", "12", ",", "日本", "word"]


def ids(text):
    return Tokenizer.from_file(packing.default_tokenizer()).encode(text, add_special_tokens=False).ids


def test_ids_are_those_of_tokenizers():
    plain, rng = Tokenizer.from_file(packing.default_tokenizer()), random.Random(8)
    texts = ["", "a <|endoftext|> b", *("".join(rng.choice(MARKS) for _ in range(rng.randint(0, 25))) for _ in range(2000))]
    got = packing.encode_all(texts, packing.default_tokenizer())
    assert got == [struct.pack(f"<{len(x)}I", *x) for x in (plain.encode(t, add_special_tokens=False).ids for t in texts)]
    assert got[1] == struct.pack("<4I", 64, 220, 50256, 275)


def test_query_and_stage_read_added_tokens(spark, tmp_path):
    import corpus_pipeline

    text = "a <|endoftext|> b"
    docs = spark.createDataFrame([(1, text), (2, None)], "doc_id long, text string")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    want = {1: [*ids(text), 0], 2: [0]}
    for found in (QUERIES["op8_packing"](spark, str(tmp_path)), corpus_pipeline.sequences(spark, docs, "")):
        assert {r["doc_id"]: (r["length"], r["ids_crc32"]) for r in found.collect()} == {k: (len(x), zlib.crc32(struct.pack(f"<{len(x)}I", *x))) for k, x in want.items()}
