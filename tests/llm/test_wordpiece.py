import public_tokenizers
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from lumenframe.llm.wordpiece import LongestMatch, byte_vocabulary, token_counts
from lumenframe.llm.words import buffers

WORD = public_tokenizers.path("word_bpe_49k.json")


def greedy(word, vocabulary, longest):
    at = n = 0
    while at < len(word):
        size = next((k for k in range(min(longest, len(word) - at), 0, -1) if word[at : at + k] in vocabulary), 0)
        if not size:
            return -1
        at, n = at + size, n + 1
    return n


@settings(max_examples=200, deadline=None)
@given(st.sets(st.text("abc", min_size=1, max_size=6), max_size=14), st.lists(st.text("abcd", min_size=1, max_size=20), max_size=20))
def test_automaton_is_greedy_longest_match(vocabulary, words):
    vocabulary = {x.encode() for x in vocabulary}
    machine = LongestMatch(sorted(vocabulary))
    words = words + ["ab" * 200]
    want = [greedy(w.encode(), vocabulary, 6) for w in words]
    assert machine.counts(*buffers(pa.array(words))).tolist() == want
    assert [machine.count(w.encode()) for w in words] == want


def test_counts_of_documents(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    odd = [(-1, None), (-2, ""), (-3, " \n "), (-4, "x" * 3000), (-4, "Ab Ab ▁"), (None, "one two")]
    docs = docs.unionAll(spark.createDataFrame(odd, "doc_id long, text string"))
    vocabulary = set(byte_vocabulary(WORD))
    longest = max(map(len, vocabulary))
    lower = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
    want = []
    for r in docs.collect():
        words = (r.text or "").encode().translate(lower).split()
        want.append((r.doc_id, len(words), sum(greedy(w, vocabulary, longest) for w in words), 0))
    got = [tuple(r) for r in token_counts(docs.selectExpr("doc_id", "text", "1 as n_tokens"), WORD).collect()]
    assert sorted(got, key=str) == sorted(want, key=str)
    assert token_counts(docs.limit(0), WORD).collect() == []
