"""Strings of special tokens, against the library as it comes."""

import zlib

import public_tokenizers as P
import pyarrow as pa
from tokenizers import Tokenizer

from postlens.llm import queries, token_files
from postlens.session import scratch_dir
from tests.llm.test_operators import pack, texts_of

TEXTS = ["a <|endoftext|> b", "<|endoftext|>", "x<|endoftext|><|endoftext|>  y", " <|endoftext|>\n", "no <|endof text|>", "", *texts_of(1500, 30, 5)]


def test_encoder_equals_the_unmodified_library():
    tokenizer = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    lengths, values = token_files.Encoder(P.path("byte_bpe_50k.json"), special=True).encode(pa.array(TEXTS), 7)
    want = [[*tokenizer.encode(t, add_special_tokens=False).ids, 7] for t in TEXTS]
    assert want[0] == [64, 220, 50256, 275, 7]
    assert lengths.tolist() == list(map(len, want)) and values.tolist() == sum(want, [])


def test_query_equals_the_unmodified_library(spark, shared):
    tokenizer, folder = Tokenizer.from_file(P.path("byte_bpe_50k.json")), scratch_dir(spark, "docs")
    spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string").write.parquet(f"{folder}/documents.parquet")
    found = {r["doc_id"]: (r["n_tokens"], r["ids_crc32"]) for r in queries.QUERIES["op8_token_files"](spark, folder).collect()}
    for i, text in enumerate(TEXTS):
        ids = [*tokenizer.encode(text, add_special_tokens=False).ids, 0]
        assert found[i] == (len(ids), zlib.crc32(pack(ids)))
