"""Token shards: exact round trip and permutation."""

import zlib

import numpy as np
import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from fleetlens.llm import tokenise
from fleetlens.llm.scratch import Scratch
from fleetlens.llm.token_shards import Permutation, read_slots, write_shards


@given(st.integers(1, 3000), st.text(max_size=5))
@settings(max_examples=60, deadline=None)
def test_permutation_is_a_keyed_bijection(n, key):
    out = Permutation(n, key)(np.arange(n))
    assert sorted(out.tolist()) == list(range(n))
    if n > 50:
        assert out.tolist() != list(range(n)) and out.tolist() != Permutation(n, key + "x")(np.arange(n)).tolist()


def test_round_trip(spark):
    path = str(pytest.importorskip("public_tokenizers").path("word_bpe_49k.json"))
    texts = [None, "", "one", "Zwei, drei!", "x " * 700] + [f"text number {i} " * (i % 9) for i in range(120)] + ["same", "same"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "slot long, text string").withColumn("n", F.lit("clash")).coalesce(1)
    scratch = Scratch(spark, "t")
    folder = scratch.path("shards")
    rows = write_shards(df, scratch, folder, path, length=64, per_shard=5).collect()
    t = tokenise.tokenizer(path)
    stream = [i for x in texts for i in t.plain.encode(x or "", add_special_tokens=False).ids + [0]]
    n = -(-len(stream) // 64)
    assert sorted(r["slot"] for r in rows) == sorted(r["sequence_id"] for r in rows) == list(range(n))
    got = list(read_slots(folder, 0, n, 64, 5))
    for r in rows:
        want = stream[64 * r["sequence_id"]:64 * r["sequence_id"] + 64]
        assert got[r["slot"]].tolist() == want + [0] * (64 - len(want)) and r["n_tokens"] == len(want)
        assert (r["shard"], r["byte_offset"]) == (r["slot"] // 5, r["slot"] % 5 * 128)
        assert r["ids_crc32"] == zlib.crc32(got[r["slot"]].tobytes())
    assert [x.tolist() for x in read_slots(folder, 3, 4, 64, 5)] == [x.tolist() for x in got[3:7]]


def test_empty_table(spark):
    path = str(pytest.importorskip("public_tokenizers").path("word_bpe_49k.json"))
    scratch = Scratch(spark, "t")
    assert write_shards(spark.createDataFrame([], "text string"), scratch, scratch.path("shards"), path).count() == 0
