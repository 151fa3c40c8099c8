"""The registered queries, their SQL texts, and the pipeline stage by stage."""

import collections

import brute
import compare
import corpus_pipeline
import numpy as np
import odd_documents
import pytest

import __spark_entry__ as entry
from gaugeframe.llm import packing, quality_rules
from gaugeframe.llm.workload import ORACLES, QUERIES, word_tokenizer

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    return compare.connect()


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_matches_sql(spark, duck, name):
    got = compare.run_spark(QUERIES[name](spark, compare.SF_DIR))
    assert got[1]
    assert compare.difference(got, compare.run_sql(duck, ORACLES[name])) is None


def test_all_are_registered():
    numbers = sorted(int(name[2:].split("_")[0]) for name in QUERIES)
    assert numbers == list(range(1, 14))
    assert {*QUERIES, "pipeline"} <= set(entry.queries())
    assert set(ORACLES) <= set(entry.oracle_sql())


def test_language_is_found_on_held_out_documents(spark):
    rows = QUERIES["op9_language_pieces"](spark, compare.SF_DIR)
    docs = spark.read.parquet(f"{compare.SF_DIR}/documents.parquet")
    both = rows.join(docs.select("doc_id", "lang"), "doc_id").where("held_out").collect()
    assert len(both) > 100
    assert np.mean([r["lang"] == r["lang_pred"] for r in both]) > 0.97


def test_rules_agree_with_labels(spark):
    rows = QUERIES["op2_quality_rules"](spark, compare.SF_DIR)
    labels = spark.read.parquet(f"{compare.SF_DIR}/labels.parquet")
    both = rows.join(labels, "doc_id").where("not base_failed").collect()
    good = [r["kept"] for r in both if r["quality"] == 1]
    assert np.mean(good) > 0.99
    assert np.mean([r["kept"] for r in both if r["quality"] == 0]) < 0.2


def test_model_beats_its_base(spark):
    rows = QUERIES["op8_kneser_ney"](spark, SMALL).where("held_out").collect()
    assert sum(r["score"] for r in rows) > sum(r["base_score"] for r in rows)


def test_edits_stay_near(spark):
    rows = QUERIES["op6_invertible_sketch"](spark, SMALL).where("n_chars > 400").collect()
    assert np.mean([r["near_edited"] > r["near_next"] + 0.2 for r in rows]) > 0.95


# --- pipeline


def rows_of(df):
    return [tuple(r) for r in df.collect()]


def stage(name):
    return dict(corpus_pipeline.STAGES)[name]


def test_stages_and_columns(spark):
    assert [name for name, _ in corpus_pipeline.STAGES] == [
        "quality_rules", "line_dedup", "near_dedup", "mixing", "packing",
    ]
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").limit(0)
    for name, f in corpus_pipeline.STAGES[:-1]:
        out = f(spark, docs, SMALL)
        assert out.columns == docs.columns and out.count() == 0, name
    assert stage("packing")(spark, docs, SMALL).count() == 0


@pytest.mark.parametrize("source", ["small", "odd"])
def test_pipeline_against_its_definition(spark, odd, source):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet") if source == "small" else odd
    names = docs.columns

    good = stage("quality_rules")(spark, docs, SMALL).cache()
    labels = spark.read.parquet(f"{SMALL}/labels.parquet")
    _, rules = quality_rules.judged_ids(docs, labels)
    kept = []
    for r in quality_rules.measured(docs).collect():
        c = brute.counts(r["doc"]["text"])
        assert tuple(r["q"][x] for x in quality_rules.COUNTS) == c
        failed = c[0] < 20 or 100 * c[4] > 30 * c[0]
        rejected = any(all((r["q"][t.measure] > t.value) == t.above for t in x) for x in rules)
        if not failed and not rejected:
            kept.append(tuple(r["doc"]))
    assert good.columns == names and sorted(map(repr, rows_of(good))) == sorted(map(repr, kept))

    cut = stage("line_dedup")(spark, good, SMALL).cache()
    i, t = names.index("doc_id"), names.index("text")
    left = brute.lines_left([(r[i], r[t]) for r in kept])
    want = [(*r[:t], "\n".join(x) if r[t] is not None else None, *r[t + 1 :]) for r, x in zip(kept, left, strict=True)]
    assert cut.columns == names and sorted(map(repr, rows_of(cut))) == sorted(map(repr, want))

    one = stage("near_dedup")(spark, cut, SMALL).cache()
    groups, _ = brute.near_groups([(r[i], r[t]) for r in want])
    want = [r for r, g in zip(want, groups, strict=True) if r[i] == g]
    assert one.columns == names and sorted(map(repr, rows_of(one))) == sorted(map(repr, want))

    mixed = stage("mixing")(spark, one, SMALL).cache()
    s = names.index("source")
    sizes, largest = collections.Counter(), collections.Counter()
    for r in want:
        n = len(brute.words(r[t]))
        key = (r[s] is None, r[s] or "")
        sizes[key] += n
        largest[key] = max(largest[key], n)
    weights = {x: (5, 2, 1)[k % 3] for k, x in enumerate(sorted(sizes))}
    targets = brute.filled(sizes, weights, 1.5 * sum(sizes.values()), 2)
    taken, copies = collections.Counter(), collections.Counter()
    have = collections.Counter(map(repr, want))
    for r in rows_of(mixed):
        taken[r[s] is None, r[s] or ""] += len(brute.words(r[t]))
        copies[repr(r)] += 1
    assert mixed.columns == names
    assert all(n <= 2 * have[r] for r, n in copies.items())
    assert all(abs(taken[x] - targets[x]) <= largest[x] for x in sizes)

    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(word_tokenizer())
    pieces = stage("packing")(spark, mixed, SMALL).collect()
    encoded = collections.Counter()
    for r in rows_of(mixed):
        ids = tokenizer.encode(r[t] or "", add_special_tokens=False).ids
        encoded[r[i], len(ids) + 1] += len(ids) + 1
    packed = collections.Counter()
    for p in pieces:
        packed[p["doc_id"], p["doc_tokens"]] += p["length"]
    assert packed == encoded
    used = collections.Counter()
    for p in pieces:
        used[p["sequence_id"]] += p["length"]
    assert all(n == 4096 or n < 4096 and n & (n - 1) == 0 for n in used.values())
    for df in (good, cut, one, mixed):
        df.unpersist()


def test_run_is_the_stages_in_a_row(spark):
    rows = corpus_pipeline.run(spark, SMALL)
    assert rows.columns == packing.digest(packing.pack(odd_documents.frame(spark), word_tokenizer())).columns
    assert rows.count() > 0
