"""Each operator against its row-by-row definition, on awkward rows."""

import collections
import fractions
import hashlib
import math

import brute
import numpy as np
import odd_documents
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from gaugeframe.llm import (
    hyperminhash,
    invertible_sketch,
    kneser_ney,
    language_pieces,
    line_dedup,
    mixing,
    packing,
    personal_data,
    quality_rules,
    substring_dedup,
)
from gaugeframe.llm.workload import word_tokenizer

ROWS = odd_documents.rows()
KEY = lambda x: tuple((v is not None, v) for v in x)


def ordered(rows):
    return sorted(rows, key=KEY)


def test_word_arrays():
    import pyarrow as pa

    from gaugeframe.llm.words import Words, text_buffers

    texts = [t for _, t, _, _ in ROWS]
    data, offsets = text_buffers(pa.array(texts, pa.string()))
    found = Words(data, offsets)
    flat = found.array().to_pylist()
    for i, t in enumerate(texts):
        assert flat[found.bounds[i] : found.bounds[i + 1]] == brute.words(t)
    by_word = collections.defaultdict(set)
    for w, h in zip(flat, found.hashes(), strict=True):
        by_word[w].add(h)
    assert all(len(h) == 1 for h in by_word.values())
    assert len({next(iter(h)) for h in by_word.values()}) == len(by_word)


# --- mixing


def test_mixing_reaches_targets(spark, odd):
    rows = mixing.mixture(mixing.sized(odd)).select("doc.doc_id", "src", "size", "source_size", "target", "repeats")
    got = rows.collect()
    assert len(got) == len(ROWS)
    sizes = collections.Counter()
    for _, text, _, source in ROWS:
        sizes["1" if source is None else "0" + source] += len(brute.words(text))
    order = sorted(sizes)
    weights = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    want = brute.filled(sizes, weights, 1.5 * sum(sizes.values()), 2)
    taken, largest = collections.Counter(), collections.Counter()
    for r in got:
        assert r["source_size"] == sizes[r["src"]] and r["target"] == pytest.approx(want[r["src"]])
        assert 0 <= r["repeats"] <= 2
        taken[r["src"]] += r["size"] * r["repeats"]
        largest[r["src"]] = max(largest[r["src"]], r["size"])
    for s in order:
        assert abs(taken[s] - want[s]) <= largest[s] / 2 + 1e-6


def test_mixing_is_repeatable_and_keeps_columns(odd, empty):
    a = mixing.mix(odd)
    assert a.columns == odd.columns
    assert ordered(a.select("doc_id", "n").collect()) == ordered(
        mixing.mix(odd.repartition(3)).select("doc_id", "n").collect()
    )
    assert mixing.mix(empty).count() == 0 and mixing.mix(empty).columns == odd.columns


def test_smaller_budgets_are_nested(odd):
    rows = mixing.sized(odd).select("doc.doc_id", "src", "size", "place")
    some = mixing.mixture(rows, share=0.5)
    more = mixing.mixture(rows, share=1.0)
    both = some.select("place", F.col("repeats").alias("a")).join(
        more.select("place", F.col("repeats").alias("b")), "place"
    )
    assert both.where("a > b").count() == 0


def test_many_levels_of_buckets(spark):
    """Places that differ in their last bits only still part at the right one."""
    rows = spark.range(200).select(
        F.lit("0a").alias("src"), F.lit(1).cast("long").alias("size"), (F.col("id") + (5 << 40)).alias("place")
    )
    budgets = spark.createDataFrame([("0a", 1, 70.2, False), ("0a", 2, 0.0, False), ("0a", 3, 200.0, True)], "src string, nth int, budget double, whole boolean")
    limits = {r["nth"]: r["threshold"] for r in mixing.thresholds(rows, budgets).collect()}
    assert limits == {1: (5 << 40) + 70, 2: 0, 3: 1 << 60}


# --- quality rules


def test_counts_and_base(odd):
    got = quality_rules.measured(odd).select("doc.doc_id", "doc.n", "q.*").collect()
    by_n = {r["n"]: r for r in got if r["n"]}
    for n, (i, text, _, _) in enumerate(ROWS):
        if n % 3:
            r, want = by_n[f"n-{n}"], brute.counts(text)
            assert tuple(r[c] for c in quality_rules.COUNTS) == want
            assert r["base_failed"] == (want[0] < 20 or 100 * want[4] > 30 * want[0])


def _labels(spark, odd_kind=False):
    rows = [(i, 0 if i % 4 == 0 else 1) for i in range(400)] + [(None, 0), (3, None), (7, 5)] * odd_kind
    return spark.createDataFrame(rows, "doc_id long, quality int")


def test_rules_are_learned_and_hold(spark):
    def text(i):
        junk = "stop### now%%% " if i % 4 == 0 else "plain words here "
        return " ".join(f"{junk}w{i}x{k}" for k in range(12))

    docs = spark.createDataFrame([(i, text(i)) for i in range(400)], "doc_id long, text string")
    rows, rules = quality_rules.judged_ids(docs, _labels(spark, True))
    assert rules and all(len(r) <= 3 for r in rules)
    assert {r["id"] for r in rows.where("kept").collect()} == {i for i in range(400) if i % 4}
    # the list as a conditional says what its thresholds say one by one
    for r in rows.collect():
        rejected = any(
            all((r["q"][t.measure] > t.value) == t.above for t in rule) for rule in rules
        )
        assert r["kept"] == (not r["q"]["base_failed"] and not rejected)


def test_many_kinds_of_junk_are_learned(spark):
    """More kinds than eight, each with a mark of its own, and one that is learned by no rule."""
    r = np.random.default_rng(12)
    rows = []
    for i in range(2400):
        kind = i % 12
        values = r.random(len(quality_rules.MEASURES)) * 0.4 + 0.3
        if kind < 9:
            values[kind] = 0.9 + r.random() * 0.1
        bad = kind < 9 or (kind == 9 and r.random() < 0.5)
        rows.append((bool(bad), bool(r.random() < 0.67), *map(float, values)))
    names = ", ".join(f"{m} double" for m in quality_rules.MEASURES)
    df = spark.createDataFrame(rows, f"bad boolean, grow boolean, {names}").coalesce(1).cache()
    rules = quality_rules.learn_rules(df, max_length=1)
    assert {rule[0].measure for rule in rules} >= set(quality_rules.MEASURES) and len(rules) >= 9
    left = df.select("bad", quality_rules.verdict(rules, "").alias("kept"))
    caught = left.where("bad and not kept").count()
    assert caught >= 9 * 200 * 0.97 and left.where("not bad and not kept").count() < 60


def test_quality_without_labels(spark, odd, empty):
    none = _labels(spark).limit(0)
    kept = quality_rules.keep_good(odd, none)
    assert kept.columns == odd.columns
    want = 0
    for _, text, _, _ in ROWS:
        c = brute.counts(text)
        want += not (c[0] < 20 or 100 * c[4] > 30 * c[0])
    assert kept.count() == want
    assert quality_rules.keep_good(empty, _labels(spark)).count() == 0


def test_quality_has_no_python(spark, odd):
    plan = quality_rules.measured(odd).select("q")._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


# --- packing


def test_packing_round_trip(odd, empty):
    from tokenizers import Tokenizer

    path = word_tokenizer()
    tokenizer = Tokenizer.from_file(path)
    pieces = packing.pack(odd.select("doc_id", "text", "id", "start", "length"), path, length=256, group_tokens=2000)
    rows = pieces.collect()
    whole = sorted(
        tuple(tokenizer.encode(t or "", add_special_tokens=False).ids + [2]) for _, t, _, _ in ROWS
    )
    sequences = collections.defaultdict(list)
    for r in rows:
        sequences[r["sequence_id"]].append(r)
        assert r["length"] * 4 == len(r["ids"])
    for parts in sequences.values():
        at = 0
        for r in sorted(parts, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at == 256 or at & (at - 1) == 0 and at < 256
    docs = collections.defaultdict(list)
    for r in rows:
        docs[r["id"], r["doc_tokens"]].append((r["start"], np.frombuffer(r["ids"], "<u4").tolist()))
    ids = collections.Counter(i for x in whole for i in x)
    assert ids == collections.Counter(i for p in docs.values() for _, x in p for i in x)
    single = {k: v for k, v in docs.items() if sum(1 for i, *_ in ROWS if i == k[0]) == 1}
    assert len(single) > 50
    text_of = {i: t for i, t, _, _ in ROWS}
    for (doc, n), parts in single.items():
        parts.sort()
        flat = [i for _, x in parts for i in x]
        assert flat == tokenizer.encode(text_of[doc] or "", add_special_tokens=False).ids + [2]
        assert n == len(flat)
    assert packing.pack(empty, path).count() == 0


@pytest.mark.parametrize(("tasks", "group"), [(200, 256), (200, 6), (3, 2)])
def test_rests_of_tasks_are_packed_together(spark, monkeypatch, tasks, group):
    """Short documents in many partitions: one sequence, and none but the last is short."""
    monkeypatch.setattr(packing, "TASKS", group)
    path = word_tokenizer()
    texts = ["one two three four five six seven"] * 400 + ["a " * k for k in range(100, 101)]
    texts += ["b"] * ((4096 - 400 * 8 - 101) // 2)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(tasks)
    rows = packing.pack(docs, path).collect()
    total = sum(r["length"] for r in rows)
    used = collections.Counter()
    for r in rows:
        used[r["sequence_id"]] += r["length"]
    assert len({r["id"] for r in rows}) == len(texts) and total in (4095, 4096)
    assert sorted(used.values()) == [1 << b for b in range(13) if total >> b & 1]


def test_packing_balances_cost():
    r = np.random.default_rng(1)
    lengths = [int(x) for x in np.minimum(r.lognormal(5, 1, 8000) + 1, 1000)]
    rooms = [4096] * (sum(lengths) // 4096)
    placed, rest = packing.assign(lengths, rooms, packing.ATTENTION)
    cost = np.zeros(len(rooms))
    for _, _, n, k, _ in placed:
        cost[k] += n + packing.ATTENTION * n * n
    assert sum(n for *_, n in rest) == sum(lengths) % 4096
    by_arrival = np.zeros(len(rooms))
    at = 0
    for n in lengths:
        while n and at < 4096 * len(rooms):
            k, room = at // 4096, 4096 - at % 4096
            take = min(n, room)
            by_arrival[k] += take + packing.ATTENTION * take * take
            n, at = n - take, at + take
    assert cost.std() < by_arrival.std() / 2


def test_unusual_letters_keep_their_ids():
    import pyarrow as pa
    from tokenizers import Tokenizer

    path = word_tokenizer()
    texts = [
        "It's o'clock. DON'T 'stop' ''s a's... 'll",
        "İstanbul ǅ ΣΑΣ. Straße é̀ ́x Å K Å ﬁ",
        "a.b,c;d -e- f_g 12ab3 x²y  nbsp em 　wide\x1cfs\x85nel",
        "汉字 漢字かな 한국어 ไทย العربية \U0001f600‍\U0001f600 <b>x</b> «q» ...»",
        "mail@x.org https://a.b/c?d=e#f <|endoftext> \x00 �",
    ]
    tokens = packing.WordTokens(path)
    single = Tokenizer.from_file(path)
    for _ in range(2):  # the second time from the cache
        for t, ids in zip(texts, tokens.texts(pa.array(texts)), strict=True):
            assert ids.tolist() == single.encode(t, add_special_tokens=False).ids


# --- near duplicates


def test_near_duplicates(odd, empty):
    got = hyperminhash.near_duplicates(odd).collect()
    groups, sizes = brute.near_groups([(i, t) for i, t, _, _ in ROWS])
    want = [(i, n, g) for (i, *_), n, g in zip(ROWS, sizes, groups, strict=True)]
    assert ordered(tuple(r) for r in got) == ordered(want)
    assert hyperminhash.near_duplicates(empty).count() == 0
    kept = hyperminhash.keep_one(odd)
    assert kept.columns == odd.columns
    assert {r["doc_id"] for r in kept.select("doc_id").collect()} >= {g for g in groups if g is not None}


def test_one_row_of_each_group_stays(spark):
    """Rows go by id and text: unique texts stay beside null or repeated ids."""
    t, u, a, b, v = (" ".join(f"{x}{k}" for k in range(30)) for x in "tuabv")
    rows = [
        (7, t, 0), (None, t, 1), (None, u, 2), (2, b, 3), (5, b, 4), (5, a, 5), (None, v, 6), (None, v, 7),
        (8, " ".join(v.split()[:20]), 8), (8, " ".join(v.split()[:20]), 8), (None, None, 9), (None, "", 9),
        (9, None, 9),
    ]
    df = spark.createDataFrame(rows, "doc_id long, text string, id int").repartition(3)
    got = [tuple(r)[:2] for r in hyperminhash.keep_one(df).collect()]
    want = [(7, t), (None, u), (2, b), (5, a), (None, v), rows[8][:2], (None, None), (None, ""), (9, None)]
    assert ordered(got) == ordered(want)


def test_rows_without_ids_are_linked_by_similarity(spark):
    words = [f"w{k}" for k in range(101)]
    edited = [*words[:50], "other", *words[51:]]
    t, u, v = " ".join(words), " ".join(edited), " ".join(f"v{k}" for k in range(60))
    rows = [(None, u), (4, t), (None, v), (None, v + " end"), (9, v + " of all")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = hyperminhash.near_duplicates(df).collect()
    assert ordered((r["id"], r["component_id"]) for r in got) == ordered([(None, 4), (4, 4), (None, 9), (None, 9), (9, 9)])
    assert ordered(tuple(r) for r in hyperminhash.keep_one(df).collect()) == ordered([(4, t), (9, v + " of all")])
    alone = spark.createDataFrame(rows[2:4], "doc_id long, text string")
    assert {r["component_id"] for r in hyperminhash.near_duplicates(alone).collect()} == {None}
    assert hyperminhash.keep_one(alone).count() == 1


def test_rows_that_differ_in_other_columns_stay(spark):
    t = " ".join(f"t{k}" for k in range(30))
    rows = [(5, t, f"2024-01-01 00:00:00.00000{k}", "x") for k in (1, 2, 2)] + [(None, "a", None, "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, at string, `a.b` string").selectExpr(
        "doc_id", "text", "cast(at AS timestamp) AS at", "`a.b`"
    )
    assert hyperminhash.keep_one(df).where("doc_id = 5").count() == 2


def test_texts_of_a_repeated_id_keep_their_links(spark):
    """Both texts of id 5 have a near copy; so do the ids that link them."""
    a, b, other = (" ".join(f"{x}{k}" for k in range(60)) for x in "abo")
    docs = [(5, a), (5, b), (7, a + " end"), (6, b + " end"), (8, other), (9, other), (9, None)]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    got = hyperminhash.near_duplicates(df).collect()
    assert sorted(r["component_id"] for r in got if r["id"] in (5, 6, 7)) == [5] * 4
    assert sorted(r["component_id"] for r in got if r["id"] == 8) == [8]
    kept = [tuple(r) for r in hyperminhash.keep_one(df).collect()]
    assert ordered(kept) == ordered([(5, a), (5, b), (8, other), (9, None)])


@pytest.mark.parametrize("crowd", [64, 3])
def test_links_in_chains_and_without_stars(spark, monkeypatch, crowd):
    """Neighbours in a chain are alike, its ends are not."""
    monkeypatch.setattr(hyperminhash, "CROWD", crowd)
    monkeypatch.setattr(hyperminhash, "BLOCK_ROWS", 4)
    words = [f"w{k}" for k in range(400)]
    docs = [(i, " ".join(words[8 * i : 8 * i + 100])) for i in range(30)]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    want = brute.near_groups(docs)[0]
    for rounds in (0, 1, 3):
        got = hyperminhash.near_duplicates(df, star_rounds=rounds).collect()
        assert [r["component_id"] for r in sorted(got)] == want
    assert len(set(want)) == 1


def test_registers_estimate_similarity():
    r = np.random.default_rng(2)
    for n, share in ((400, 0.5), (5000, 0.8), (20, 0.75)):
        errors = []
        for _ in range(30):
            pool = r.integers(0, 2**64, 2 * n, np.uint64)
            both = int(2 * n * share / (1 + share))
            rest = (2 * n - both) // 2
            a = np.unique(np.concatenate((pool[:both], pool[both : both + rest])))
            b = np.unique(np.concatenate((pool[:both], pool[both + rest : both + 2 * rest])))
            regs = hyperminhash.registers([a, b])
            equal = (regs[0] == regs[1]).mean()
            chance = hyperminhash.chance_of_equal(np.array([len(a)]), np.array([len(b)]))[0]
            true = len(np.intersect1d(a, b)) / len(np.union1d(a, b))
            errors.append((equal - chance) / (1 - chance) - true)
        assert abs(np.mean(errors)) < 0.04


# --- repeated passages


@pytest.mark.parametrize("crowded", [10_000, 2])
def test_repeated_passages(odd, empty, crowded):
    got = substring_dedup.remove_repeated(odd, anchor_segments=crowded, shard_bytes=1 << 14).collect()
    want = [
        (i, len(brute.words(t)), gone, kept)
        for (i, t, *_), (kept, gone) in zip(ROWS, brute.repeats_removed([t for _, t, *_ in ROWS], 35), strict=True)
    ]
    assert ordered(tuple(r) for r in got) == ordered(want)
    assert substring_dedup.remove_repeated(empty).count() == 0


def test_small_windows(spark):
    r = np.random.default_rng(4)
    docs = [(i, " ".join(r.choice(list("abcd"), int(r.integers(0, 60))))) for i in range(60)]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    got = substring_dedup.remove_repeated(df, window=6, gram=3, anchor_segments=5, shard_bytes=500)
    want = brute.repeats_removed([t for _, t in docs], 6)
    assert {r["id"]: (r["kept"], r["n_removed"]) for r in got.collect()} == dict(enumerate(want))


# --- invertible sketches


def test_fingerprints_of_versions(odd, empty):
    got = invertible_sketch.fingerprints(odd.select("doc_id", "text", "id", "range")).collect()
    rows = sorted(((i, t or "") for i, t, *_ in ROWS), key=KEY)
    want = []
    for k, (i, text) in enumerate(rows):
        following = rows[(k + 1) % len(rows)][1]
        n = len(text) // 4
        want.append((i, len(text), text[: len(text) - n] + following[:n]))
    assert ordered((r["id"], r["n_chars"], r["edited"]) for r in got) == ordered(want)
    same = collections.defaultdict(set)
    for r in got:
        assert 0 <= r["near_next"] <= 1 and 0 <= r["near_edited"] <= 1
        if r["n_chars"] == 0:
            assert r["near_edited"] == 1
    texts = {i: t for i, t, *_ in ROWS}
    for r in got:
        same[texts[r["id"]] if r["id"] not in (None, 5) else object()].add(r["fingerprint"])
    assert all(len(x) == 1 for x in same.values())
    assert invertible_sketch.fingerprints(empty).count() == 0


@pytest.mark.parametrize("ranges", [1, 3, 40])
def test_neighbours_do_not_depend_on_ranges(spark, ranges):
    docs = spark.createDataFrame([(7 * i, f"text {i} " * 9) for i in range(25)], "doc_id long, text string")
    got = {r["id"]: r["edited"] for r in invertible_sketch.fingerprints(docs, ranges=ranges).collect()}
    for i in range(25):
        text, following = f"text {i} " * 9, f"text {(i + 1) % 25} " * 9
        n = len(text) // 4
        assert got[7 * i] == text[: len(text) - n] + following[:n]


@pytest.mark.parametrize("ranges", [1, 3, 8, 40])
@pytest.mark.parametrize("null", [False, True])
def test_large_ids_lose_no_row(spark, ranges, null):
    rows = [(2**60 + 1000 * i + 1, f"text {i} " * 9) for i in range(40)]
    rows += [(-(2**62) - 7, "before all others"), (2**63 - 1, "after all others")]
    rows = sorted(rows) if not null else [(None, "no id " * 5), *sorted(rows)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(7)
    got = {r["id"]: r["edited"] for r in invertible_sketch.fingerprints(docs, ranges=ranges).collect()}
    assert len(got) == len(rows)
    for k, (i, text) in enumerate(rows):
        following = rows[(k + 1) % len(rows)][1]
        n = len(text) // 4
        assert got[i] == text[: len(text) - n] + following[:n]


def test_ids_must_be_integers(spark):
    with pytest.raises(ValueError, match="integers"):
        invertible_sketch.fingerprints(spark.createDataFrame([("a", "b")], "doc_id string, text string"))


def test_peeling_recovers_all_differences():
    r = np.random.default_rng(3)
    texts = 40
    a, b = [], []
    for k in range(texts):
        both = r.integers(0, 2**64, int(r.integers(0, 300)), np.uint64)
        a.append(np.unique(np.concatenate((both, r.integers(0, 2**64, 5 * k, np.uint64)))))
        b.append(np.unique(np.concatenate((both, r.integers(0, 2**64, 2 * k, np.uint64)))))
    flat = [
        (np.concatenate(x), np.repeat(np.arange(texts), [len(y) for y in x])) for x in (a, b)
    ]
    keys, owners, signs, rounds = invertible_sketch.differences(*flat, texts)
    for k in range(texts):
        mine = owners == k
        assert set(keys[mine & (signs == 1)]) == set(a[k]) - set(b[k])
        assert set(keys[mine & (signs == -1)]) == set(b[k]) - set(a[k])
    assert rounds[0] == 1 and rounds[-1] > 1


# --- lines


def test_repeated_lines(odd, empty):
    got = line_dedup.without_repeated_lines(odd).select("doc.doc_id", "lines", "left").collect()
    want = [
        (i, (t or "").split("\n"), left)
        for (i, t, *_), left in zip(ROWS, brute.lines_left([(i, t) for i, t, *_ in ROWS]), strict=True)
    ]
    assert ordered(tuple(r) for r in got) == ordered(want)
    assert line_dedup.without_repeated_lines(empty).count() == 0
    kept = line_dedup.drop_repeated_lines(odd)
    assert kept.columns == odd.columns
    assert kept.where("text is null").count() == sum(t is None for _, t, *_ in ROWS)


def test_lines_with_a_full_filter(spark, monkeypatch):
    """A filter that suspects everything changes no result."""
    monkeypatch.setattr(line_dedup, "MIN_BITS", 3)
    docs = [(i, "\n".join(f"a line that has the number {i * k % 37}" for k in range(30))) for i in range(60)]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    rows = line_dedup.without_repeated_lines(df, max_bits=3).select("doc.doc_id", "left").collect()
    assert {r["doc_id"]: r["left"] for r in rows} == dict(enumerate(brute.lines_left(docs)))


# --- language model


def test_language_model(odd, empty):
    known = [t for i, t, *_ in ROWS if i is not None and i % 3]
    model = kneser_ney.train(odd.where("doc_id % 3 <> 0").select("text", "id"))
    exact = brute.PairModel(known)
    assert (model.tokens, model.types, model.pair_types) == (exact.n, exact.v, len(exact.pairs))
    got = kneser_ney.score(odd, model).collect()
    want = [(i, *exact.scores(t)) for i, t, *_ in ROWS]
    for r, w in zip(ordered(tuple(r) for r in got), ordered(want), strict=True):
        assert r[:3] == w[:3] and r[3:] == pytest.approx(w[3:], rel=1e-9)
    assert kneser_ney.score(empty, model).count() == 0


def test_probabilities_sum_to_one(odd):
    exact = brute.PairModel([t for _, t, *_ in ROWS])
    for v in ("<s> ", "same", "ab", "never seen"):
        total = sum(exact.pair(v, w) for w in exact.count) + exact.pair(v, "never seen")
        assert total == pytest.approx(1)


def test_counts_beyond_32_bits():
    keys = np.array([3, 2**33 + 1, 2**40, 2**64 - 1], np.uint64)
    counts = np.array([1, 2**32, 7, 2**45 + 5], np.uint64)
    got = kneser_ney.decoded(kneser_ney.coded(keys, counts))
    assert got[0].tolist() == keys.tolist() and got[1].tolist() == counts.tolist()
    assert kneser_ney.narrow(counts).tolist() == counts.tolist()
    assert kneser_ney.narrow(counts[:1]).dtype == np.uint32
    parts = [(k, x) for batch in _handed_out(keys, counts) for k, x in zip(*map(pa_list, batch.columns), strict=True)]
    assert [k for k, _ in parts] == [0, 2, 3]


def pa_list(column):
    return column.to_pylist()


def _handed_out(keys, counts):
    held = kneser_ney.Counts(np.array([2**33, 2**34, 2**50], np.uint64))
    yield from held.add(keys[[0]], counts[[0]])
    yield from held.add(keys[2:], counts[2:])
    yield from held.out()


def test_language_model_without_training(odd, empty):
    model = kneser_ney.train(empty.select("text"))
    got = kneser_ney.score(odd, model).collect()
    assert all(r["n_known"] == 0 and r["score"] == r["base_score"] == 0 for r in got)


# --- languages


def _pieces(*pieces):
    return language_pieces.Pieces(list(pieces))


def test_forward_sums_all_segmentations():
    pieces = _pieces("▁", "a", "b", "ab", "▁a", "bab")
    table = np.array([[0.3], [0.2], [0.1], [0.15], [0.05], [0.1], [1e-7]])
    p = dict(zip(["▁", "a", "b", "ab", "▁a", "bab"], table[:, 0], strict=False))

    def total(text):
        if not text:
            return 1.0
        out = 0.0
        for k in range(1, len(text) + 1):
            q = p.get(text[:k], 1e-7 if k == 1 else 0)
            out += q * total(text[k:]) if q else 0
        return out

    for word in ("a", "ab", "abab", "babab", "xa", "b" * 9):
        got = language_pieces.log_probabilities(pieces, table, [word])[0, 0]
        assert got == pytest.approx(np.log(total("▁" + word)))


def _log_sum(text, p):
    """Logarithm of the sum over all segmentations, by exact fractions."""
    sums = [fractions.Fraction(1)]
    for end in range(1, len(text) + 1):
        known = [(k, p[text[end - k : end]]) for k in range(1, min(end, 6) + 1) if text[end - k : end] in p]
        if text[end - 1] not in p:
            known.append((1, fractions.Fraction(1, 10**7)))
        sums.append(sum(sums[end - k] * q for k, q in known))
    return math.log(sums[-1].numerator) - math.log(sums[-1].denominator)


@pytest.mark.parametrize("scale", [1, 10**-9, 10**-14])
def test_long_words_are_summed_whole(scale):
    pieces = ["▁", "a", "b", "ab", "▁a", "bab", "aabba"]
    r = np.random.default_rng(8)
    table = np.append(r.random((7, 2)) * scale, [[1e-7, 1e-7]], axis=0)
    words = ["".join(r.choice(list("abab?"), n)) for n in (1, 31, 32, 33, 64, 100, 777, 2000, 5, 5)]
    got = language_pieces.log_probabilities(_pieces(*pieces), table, words)
    for k in range(2):
        p = {w: fractions.Fraction(x) for w, x in zip(pieces, table[:, k], strict=False)}
        want = [_log_sum("▁" + w, p) for w in words]
        assert np.allclose(got[:, k], want, rtol=1e-12)


def test_expected_uses_are_slopes_of_the_logarithm():
    pieces = _pieces("▁", "a", "b", "ab", "▁a", "bab")
    r = np.random.default_rng(2)
    table = np.append(r.random((6, 2)) * 1e-8, [[1e-12, 1e-12]], axis=0)
    words = ["ab", "babab", "".join(r.choice(list("ab?"), 90)), "b" * 33]
    n = r.random((4, 2)) * 5
    uses = language_pieces.expected_uses(pieces, table, words, n)
    for i in range(7):
        more = table.copy()
        more[i] *= 1 + 1e-6
        rise = (language_pieces.log_probabilities(pieces, more, words) - language_pieces.log_probabilities(pieces, table, words)) * n
        assert np.allclose(uses[i], rise.sum(axis=0) / 1e-6, rtol=1e-3, atol=1e-4)


def test_rare_languages_are_learned_whole(spark):
    assert language_pieces.parts_of({"a": 5, "b": 1000, "c": 10**12}, 900) == {"a": 5, "b": 447, "c": 448}
    rows = [(i, f"text {i}", "common") for i in range(3000)] + [(i, f"rare {i}", "rare") for i in range(7)]
    known = spark.createDataFrame([*rows, (None, "x", "common")], "id long, text string, lang string")
    taken = language_pieces.chosen(known, {"common": 3001, "rare": 7}, 600).groupBy("lang").count().collect()
    taken = {r["lang"]: r["count"] for r in taken}
    assert taken["rare"] == 7 and 500 < taken["common"] < 690
    huge = language_pieces.chosen(known, {"common": 10**14, "rare": 10**13}, 20_000)
    assert huge.count() == 0  # shares far below a millionth are numbers still


def test_whole_prediction(spark):
    """Scores of the table that was learned, word by word."""
    path = public_tokenizers.path("piece_bpe_32k.model")
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text", "lang")
    found = {r["id"]: r for r in language_pieces.predict_language(docs, docs, path).collect()}
    rows = docs.collect()
    pieces = language_pieces.vocabulary(path)
    counts = collections.Counter(r["lang"] for r in rows if r["text"] is not None and r["lang"] is not None)
    langs = sorted(counts)
    known = docs.where("text is not null and lang is not null").withColumnRenamed("doc_id", "id")
    table = language_pieces.learn(known, pieces, langs)
    p = [dict(zip(pieces, table[:, k], strict=False)) for k in range(len(langs))]
    longest = max(map(len, pieces))

    def log_sum(word, k):
        sums, scale = [1.0], 0.0
        for end in range(1, len(word) + 1):
            now = 0.0 if word[end - 1] in p[k] else sums[end - 1] * table[-1, k]
            for n in range(1, min(end, longest) + 1):
                if (q := p[k].get(word[end - n : end])) is not None:
                    now += sums[end - n] * q
            sums.append(now)
            if now < 1e-200:
                sums, scale = [x / now for x in sums], scale + math.log(now)
        return math.log(sums[-1]) + scale

    total, cache = sum(counts.values()), {}
    for r in rows[:40]:
        if not r["text"]:
            continue
        score = [math.log(counts[x] / total) for x in langs]
        for word in brute.words(r["text"].lower()):
            if word not in cache:
                cache[word] = [log_sum("▁" + word, k) for k in range(len(langs))]
            score = [a + b for a, b in zip(score, cache[word], strict=True)]
        best = max(range(len(langs)), key=lambda k: score[k])
        assert found[r["doc_id"]]["lang"] == langs[best]
        assert found[r["doc_id"]]["score"] == pytest.approx(1 / sum(math.exp(x - score[best]) for x in score), rel=1e-6)


def test_expected_uses_raise_likelihood():
    pieces = _pieces("▁", "a", "b", "ab", "▁a", "bab")
    table = np.full((7, 1), 1 / 7)
    words, n = ["ab", "abab", "bab"], np.array([[5.0], [2.0], [1.0]])
    before = -np.inf
    for _ in range(4):
        now = float((language_pieces.log_probabilities(pieces, table, words) * n).sum())
        assert now >= before - 1e-9
        before = now
        table = language_pieces.expected_uses(pieces, table, words, n) + 1e-9
        table /= table.sum()


def test_language_of_odd_documents(spark, odd, empty):
    path = public_tokenizers.path("piece_bpe_32k.model")
    texts = [
        (1000 + i, t * 3, lang)
        for i, (t, lang) in enumerate(
            [("the house and the garden were quiet ", "en"), ("das Haus und der Garten waren still ", "de")] * 10
        )
    ]
    known = spark.createDataFrame(
        [*texts, (1, None, "en"), (2, "x", None)], "doc_id long, text string, lang string"
    )
    got = language_pieces.predict_language(odd, known, path).collect()
    assert len(got) == len(ROWS)
    for r in got:
        assert 0 <= r["score"] <= 1
    by_id = {r["id"]: r for r in got}
    for i in (30, 31, 32, 41):
        assert (by_id[i]["lang"], by_id[i]["score"]) == ("und", 0.0)
    seen = language_pieces.predict_language(known, known, path).collect()
    truth = {i: lang for i, _, lang in texts}
    assert all(r["lang"] == truth[r["id"]] for r in seen if r["id"] in truth)
    assert language_pieces.predict_language(empty, known, path).count() == 0
    none = language_pieces.predict_language(odd, empty, path)
    assert {r["lang"] for r in none.collect()} == {"und"}


# --- personal data


def test_base_spans(odd, empty):
    rows = personal_data.find_personal_data(odd).select(
        "doc.doc_id", "text", personal_data.listing(personal_data.BASE).alias("spans")
    )
    for r in rows.collect():
        assert r["spans"] == ",".join(brute.base_spans(r["text"]))
    assert personal_data.find_personal_data(empty).count() == 0


def test_context_and_checks_add_spans(spark):
    texts = [
        "my iban: GB82 WEST 1234 5698 7654 32.",
        "my iban: GB83 WEST 1234 5698 7654 32.",
        "GB82 WEST 1234 5698 7654 32 without a word before",
        "tel (089) 123 45678",
        "number (089) 123 45678",
    ]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    rows = personal_data.find_personal_data(df).select("doc.doc_id", "iban", "phone_local").collect()
    found = {r["doc_id"]: (len(r["iban"]), len(r["phone_local"])) for r in rows}
    assert found == {0: (1, 0), 1: (0, 0), 2: (0, 0), 3: (0, 1), 4: (0, 0)}


def test_personal_data_has_no_python(odd):
    plan = personal_data.find_personal_data(odd)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_digest_of_pieces(odd):
    path = word_tokenizer()
    rows = packing.pack(odd, path).withColumn("crc", F.crc32("ids")).select("ids", "crc").collect()
    for r in rows[:50]:
        assert r["crc"] == brute.crc_of_ids(np.frombuffer(r["ids"], "<u4"))


def test_no_documents_of_one_digest():
    assert hashlib.blake2b(b"", digest_size=16).digest() == substring_dedup.digest_of(np.zeros(0, np.uint64))
