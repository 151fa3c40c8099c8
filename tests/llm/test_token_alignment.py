"""Alignment of two tokenizers against tokens of whole texts."""

import brute
import compare
import odd_documents
import public_tokenizers
import pytest

from gaugeframe.llm import token_alignment
from gaugeframe.llm.workload import QUERIES

PATHS = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
COLUMNS = ["n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
UNUSUAL = [
    " ", "  ", " a", "a ", "\n", "a\n b", "a\n  b\t\tc", "x  y   z", "don't 're,'s x's3d'll", "a▁b", "▁",
    "<|endoftext|> <s> </s> <unk> <0x0A>", "nul\x00 and \x1f bell", "a  b　 c  d​ e\x85 f",
    "日本語の 文章、です。", "\U0001f600\U0001f600 x", "ﬁ ｆｕｌｌ éé", "'quoted,' (a)b;c:d-e_f/g\\h 3,141.59x7",
    "if(a==b){return;}", "'" * 50 + "s", "....", "trailing, \n \n", "\r\n\r\nx", "\t\ttabs", "a\x7f b", "İstanbul ŞŞ",
]


def rows(df):
    return sorted(
        [(r["id"], *(r[c] for c in COLUMNS)) for r in df.collect()], key=lambda r: (r[0] is None, str(r))
    )


def expected(pairs):
    found = brute.alignment([t for _, t in pairs], *PATHS)
    return sorted([(i, *f) for (i, _), f in zip(pairs, found, strict=True)], key=lambda r: (r[0] is None, str(r)))


@pytest.fixture(scope="module")
def awkward():
    texts = [(i, t) for i, t, *_ in odd_documents.rows()]
    return texts + [(1000 + k, t) for k, t in enumerate(UNUSUAL)]


@pytest.mark.parametrize(("run_segments", "fan_in"), [(1 << 21, 256), (4000, 2)])
def test_awkward_texts(spark, awkward, run_segments, fan_in):
    docs = spark.createDataFrame(awkward, "doc_id long, text string").repartition(5)
    got = token_alignment.align(docs, *PATHS, run_segments=run_segments, fan_in=fan_in)
    assert rows(got) == expected(awkward)


def test_extra_columns_and_empty_table(odd, empty):
    docs = [(i, t) for i, t, *_ in odd_documents.rows()]
    assert rows(token_alignment.align(odd, *PATHS)) == expected(docs)
    assert token_alignment.align(empty, *PATHS).collect() == []


def test_without_any_tokens(spark):
    docs = spark.createDataFrame([(1, None), (2, ""), (3, "▁")], "doc_id long, text string")
    assert rows(token_alignment.align(docs, *PATHS)) == [(i, 0, 0, 0, 0, 0, 0, "") for i in (1, 2, 3)]


def test_query_on_whole_table(spark):
    small = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{small}/documents.parquet").collect()
    got = QUERIES["op13_spill_alignment"](spark, small).withColumnRenamed("doc_id", "id")
    assert rows(got) == expected([(r["doc_id"], r["text"]) for r in docs])


def test_pairs_of_the_corpus(spark):
    docs = spark.createDataFrame([(1, "a b"), (2, "a a"), (3, "b ab")], "doc_id long, text string")
    runs = token_alignment.spill(docs.repartition(3), *PATHS)
    pairs = token_alignment.pair_counts(runs, 32000, fan_in=2).collect()
    assert sorted(p["n_docs"] for p in pairs) == [1, 2, 2]
    assert all(p["best"] for p in pairs)


def test_segments_end_where_no_token_spans(spark):
    """Tokens of whole texts of the table never cross a cut."""
    tokenizers = token_alignment.Tokenizers(*PATHS)
    docs = spark.read.parquet(f"{compare.SF_DIR}/documents.parquet").where("text <> ''").limit(200)
    import numpy as np

    for r in docs.collect():
        data = np.frombuffer((" " + r["text"]).encode(), np.uint8)
        cuts = set(tokenizers.segments(data, np.array([0])).tolist())
        a = tokenizers.byte.encode(" " + r["text"], add_special_tokens=False).ids
        b = tokenizers.piece.encode(r["text"])
        for ids, vocabulary in ((a, tokenizers.a), (b, tokenizers.b)):
            begins = np.cumsum(vocabulary.lengths[ids]) - vocabulary.lengths[ids]
            assert cuts <= set(begins.tolist())


def test_counts_above_32_bits_are_kept():
    import numpy as np

    most = (1 << 32) - 1
    run = token_alignment._press(np.array([5 << 32 | most, 7 << 32 | 3], np.uint64))
    merged = token_alignment._merged([run, run, run])
    pairs, counts = token_alignment._totals(merged)
    assert pairs.tolist() == [5, 7] and counts.tolist() == [3 * most, 9]
    again = token_alignment._press(merged)
    assert token_alignment._totals(token_alignment._merged([again, run]))[1].tolist() == [4 * most, 12]
