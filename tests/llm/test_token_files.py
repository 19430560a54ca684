import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from lumenframe.llm import eliasfano
from lumenframe.llm.token_files import ChunkEncoder, TokenFile, read_digests, write_token_files

WORD = public_tokenizers.path("word_bpe_49k.json")
BYTE = public_tokenizers.path("byte_bpe_50k.json")
ENCODERS = {f: (ChunkEncoder(f), Tokenizer.from_file(f)) for f in (WORD, BYTE)}


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(-(2**40), 2**40), max_size=700), st.booleans())
def test_elias_fano_round_trip_and_select(values, dense):
    values = sorted(x % 5 for x in values) if dense else sorted(values)
    data = b"head" + eliasfano.encode(np.array(values, np.int64)) + b"tail"
    seq = eliasfano.Sequence(data, 4)
    assert seq.all().tolist() == values and [seq[i] for i in range(len(seq))] == values
    assert data[seq.end :] == b"tail"


def test_elias_fano_is_near_minimal_and_refuses_descents():
    ends = np.cumsum(np.random.default_rng(0).integers(1, 2000, 50_000))
    assert 8 * len(eliasfano.encode(ends)) / len(ends) < np.log2(ends[-1] / len(ends)) + 2.5
    with pytest.raises(ValueError):
        eliasfano.encode(np.array([2, 1]))


@pytest.mark.parametrize("file", [WORD, BYTE])
@settings(max_examples=150, deadline=None)
@given(st.lists(st.one_of(st.none(), st.text(max_size=60), st.lists(st.sampled_from(["it's", "Don'T", "a.", "é,", "\x01", "̸", "=", "<|endoftext|>", "<|ENDOFTEXT|>", "ΣΑΣ", "x y", " ", "\n", "12.5", "...", "İx", "中文。", ".́", "'", "s", "😀!"]), max_size=12).map("".join)), max_size=5))
def test_chunks_give_the_ids_of_whole_texts(file, texts):
    encoder, plain = ENCODERS[file]
    ids, counts = encoder.encode(pa.array(texts, pa.string()))
    want = [plain.encode(t or "", add_special_tokens=False).ids for t in texts]
    assert counts.tolist() == [len(x) for x in want] and ids.tolist() == [y for x in want for y in x]


@pytest.mark.parametrize("file", [WORD, BYTE])
def test_files_round_trip(spark, tmp_path, file):
    texts = ["b c d", None, "", "Don't " * 3000, " \n", "same", "same", "x" * 5000, "Ünï ́ ..,"]
    rows = [(10 * (7 - i), t, "clash") for i, t in enumerate(texts)] + [(None, "no id", "y"), (20, "b c d", "z"), (20, "b c d", "z")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, start string")
    files = write_token_files(docs, f"file://{tmp_path}/ids", file, 2)
    got = read_digests(spark, files, block=64).collect()
    plain = Tokenizer.from_file(file)
    want, at = [], 0
    for doc_id, text, _ in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0)):
        ids = np.array(plain.encode(text or "", add_special_tokens=False).ids + [2], "<u4")
        want.append((doc_id, at, len(ids), zlib.crc32(ids.tobytes())))
        at += len(ids)
    assert sorted(map(tuple, got), key=lambda r: r[1]) == want
    last = TokenFile(files[-1]["file"])
    assert last.find(10**9) is None and last.find(last.doc_ids[0]).tolist()[-1] == 2
    assert write_token_files(docs.limit(0), f"file://{tmp_path}/none", file, 2) == []
    assert read_digests(spark, []).collect() == []
