"""Metadata documents, sources, sinks and the report."""

import io
import json

import compare
import numpy as np
import pytest

import gaugeframe as gf
import workload
from gaugeframe.operators import metadata


def documents(spark, *docs):
    texts = [(i, d if isinstance(d, str) else json.dumps(d)) for i, d in enumerate(docs)]
    return spark.createDataFrame(texts, "doc_id int, doc string")


DOCS = [
    {"z": 1, "a": {"y": True, "b": [{"c": "x", "a": None}, [1, {"q": 2}], "s"]}, "e": {}, "l": [], "n": None},
    {"looks": '{"k": 1}', "list": '["x"]', "deep": {"a": {"b": {"c": {"d": {"e": 1}}}}}},
    {"a_b": 1, "x": 0, "a": {"b": 2, "c": 3}, "a_c": 4},
    {"with.dot": 1, "@type": "t", "quote'": [1.5, -2, 1e3], "ünï": "é"},
    {},
]
# what each of DOCS flattens to, in order
LEAVES = [
    [
        ("z", "1"), ("a_y", "true"), ("a_b_1_c", "x"), ("a_b_1_a", None),
        ("a_b_2", '[1,{"q":2}]'), ("a_b_3", "s"), ("n", None),
    ],
    [("looks", '{"k": 1}'), ("list", '["x"]'), ("deep_a_b_c_d_e", "1")],
    [("a_b", "2"), ("x", "0"), ("a_c", "4")],
    [
        ("with.dot", "1"), ("@type", "t"), ("quote'_1", "1.5"), ("quote'_2", "-2"),
        ("quote'_3", "1000.0"), ("ünï", "é"),
    ],
    [],
]


def test_leaves_keep_document_order(spark):
    got = gf.flatten_documents(documents(spark, *DOCS)).collect()
    for i, want in enumerate(LEAVES):
        mine = sorted((r for r in got if r["doc_id"] == i), key=lambda r: r["ord"])
        assert [(r["key"], r["value"]) for r in mine] == want


def test_depth_is_measured(spark):
    nested = "x"
    for level in range(15, 0, -1):
        nested = {f"l{level}": nested, "end": [level]}
    broken = "[" * 50 + '{"never": "closed"'
    quoted = {"text": '[[[[{{{{"', "more": "\\"}
    got = gf.flatten_documents(documents(spark, nested, broken, quoted)).collect()
    keys = {r["key"]: r["value"] for r in got if r["doc_id"] == 0}
    assert keys["_".join(f"l{k}" for k in range(1, 16))] == "x" and len(keys) == 16
    assert {r["key"]: r["value"] for r in got if r["doc_id"] == 2} == quoted


def test_files_that_cannot_be_used_have_a_status(spark, tmp_path):
    bodies = {
        "a b+c%.json": b'{"title": "t"}', "bom.json": b"\xef\xbb\xbf" + b'{"title": "t"}', "list.json": b"[1]",
        "empty.json": b"", "broken.json": b'{"title": ', "bytes.json": b'{"title": "\xff"}', "large.json": b'{"x": "' + b"y" * 500 + b'"}',
    }
    for name, body in bodies.items():
        (tmp_path / name).write_bytes(body)
    docs = gf.read_documents(spark, str(tmp_path), max_bytes=400)
    got = {r["doc_id"].rsplit("/", 1)[1]: r["status"] for r in docs.collect()}
    assert got == {
        "a b+c%.json": "ok", "bom.json": "ok", "list.json": "invalid",
        "broken.json": "invalid", "bytes.json": "not text", "large.json": "too large",
    }
    scores = gf.dcat_scores(docs).filter("principle = 'Total'").collect()
    assert [r["passed"] for r in scores] == [1, 1]
    report = gf.readiness_report(docs.select("doc_id", "doc"), {"fair_dcat": {}})
    assert report.filter("key = 'passed' and subject like '%bom.json | Total'").first()["value"] == 1


def test_documents_of_all_levels(spark, tmp_path):
    """Folders that look like keys stay part of the path and add no column."""
    places = [tmp_path / "a.json", tmp_path / "in" / "b.json", tmp_path / "in" / "key=1" / "c.json"]
    for place in places:
        place.parent.mkdir(exist_ok=True)
        place.write_text("{}")
    names = lambda docs: sorted(r["doc_id"].rsplit("/", 1)[1] for r in docs.collect())
    found = gf.read_documents(spark, str(tmp_path), recursive=True)
    assert found.columns == ["doc_id", "doc", "status"]
    assert names(found) == ["a.json", "b.json", "c.json"]


def test_fair_files_are_written_by_many_tasks(spark, tmp_path, monkeypatch):
    folders = iter([tmp_path / "files", tmp_path / "read"])
    monkeypatch.setattr(workload.documents, "new_folder", lambda _: str(next(folders)))
    rows = workload.QUERIES["fair_files"](spark, compare.SF_DIR).collect()
    files = list((tmp_path / "files").glob("*/*.txt"))
    assert len(files) == len(rows) == len({r["doc_id"] for r in rows})
    assert len({f.name.split("-")[1] for f in files}) > 1


def test_two_hundred_levels_beside_flat_documents(spark):
    nested = {"end": "x"}
    for level in range(199, 0, -1):
        nested = {f"l{level}": nested} if level % 2 else {f"l{level}": [nested, level]}
    flat = {"title": "t", "brackets": "{[" * 300}
    got = gf.flatten_documents(documents(spark, nested, flat)).collect()
    deep = [r for r in got if r["doc_id"] == 0]
    assert len(deep) == 100 and {r["value"] for r in deep if r["key"].endswith("_end")} == {"x"}
    assert {r["key"]: r["value"] for r in got if r["doc_id"] == 1} == flat


def test_scores_in_the_row_are_those_of_the_checks(spark):
    table = documents(spark, *DOCS, {"title": 1, "format": 2, "x": {"format": 3}}, "[1]", {"titles": None})
    for checks, scores in ((gf.dcat_checks, gf.dcat_scores), (gf.datacite_checks, gf.datacite_scores)):
        got, want = scores(table), gf.fair_scores(checks(table))
        assert got.columns == want.columns
        assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
        assert "Exchange" not in got._jdf.queryExecution().executedPlan().toString()


def test_invalid_documents_have_a_status_and_no_score(spark):
    table = documents(spark, {"title": 1}, "[1, 2]", "{broken", '"text"', "", {})
    status = {r["doc_id"]: r["status"] for r in gf.document_status(table).collect()}
    assert status == {0: "ok", 1: "invalid", 2: "invalid", 3: "invalid", 4: "invalid", 5: "ok"}
    for checks in (gf.dcat_checks(table), gf.datacite_checks(table)):
        assert {r["doc_id"] for r in gf.fair_scores(checks).collect()} == {0, 5}


def test_a_given_depth_is_a_limit(spark):
    docs = documents(spark, {"a": {"b": {"c": 1}}})
    assert gf.flatten_documents(docs, max_depth=3).count() == 1
    with pytest.raises(Exception, match="deeper than 2"):
        gf.flatten_documents(docs, max_depth=2).collect()


def test_no_field_ends_with_another():
    fields = {f for group in metadata.DCAT_FIELDS.values() for f in group}
    assert not [(a, b) for a in fields for b in fields if a != b and a.endswith(b)]
    assert [len(g) for g in metadata.DCAT_FIELDS.values()] == [6, 6, 6, 8]
    assert [len(g) for g in metadata.DATACITE_FIELDS.values()] == [10, 1, 1, 7]


# documents, the fields that find a key, and the keys that are left over
CLAIMS = [
    (
        {"subtitle": "late", "title": "x", "description": "one", "formats": 1, "my_format": "f", "format": "g"},
        {
            ("Findable", "title"): "subtitle",
            ("Findable", "description"): "description",
            ("Interoperable", "format"): "my_format",
            ("Reusable", "format"): "format",
        },
        ["title", "formats"],
    ),
    (
        {"distribution": [{"title": "t", "format": "a"}, {"format": "b", "description": "d"}], "description": ["p", "q", "r"]},
        {
            ("Findable", "title"): "distribution_1_title",
            ("Findable", "description"): "distribution_2_description",
            ("Interoperable", "format"): "distribution_1_format",
            ("Reusable", "description"): "description_1",
            ("Reusable", "format"): "distribution_2_format",
        },
        ["description_2", "description_3"],
    ),
    (
        {"keyword": ["a", "b"], "bureauCode_12": "x", "license": None, "contactPoint": {"fn": 1}},
        {
            ("Findable", "keyword"): "keyword_1",
            ("Reusable", "license"): "license",
            ("Reusable", "bureauCode"): "bureauCode_12",
        },
        ["keyword_2", "contactPoint_fn"],
    ),
    *[(doc, {}, [key for key, _ in leaves]) for doc, leaves in zip(DOCS, LEAVES, strict=True)],
]


def test_dcat_fields_claim_keys_in_order(spark):
    table = documents(spark, *[doc for doc, _, _ in CLAIMS])
    checks = gf.dcat_checks(table).collect()
    others = gf.other_keys(table).collect()
    scores = {(r["doc_id"], r["principle"]): (r["passed"], r["failed"], r["total"]) for r in gf.fair_scores(gf.dcat_checks(table)).collect()}
    for i, (_, found, rest) in enumerate(CLAIMS):
        mine = [r for r in checks if r["doc_id"] == i]
        assert len(mine) == 26
        assert {(r["principle"], r["field"]): r["matched_key"] for r in mine if r["passed"]} == found
        assert all(r["passed"] == (r["matched_key"] is not None) for r in mine)
        assert sorted(r["key"] for r in others if r["doc_id"] == i) == sorted(rest)
        assert scores[i, "Total"] == (len(found), 26 - len(found), 26)


@pytest.mark.parametrize("with_fields", [True, False])
def test_datacite_fields(spark, with_fields):
    fields = [f for group in metadata.DATACITE_FIELDS.values() for f in group]
    doc = {f: (None if i % 2 else [1]) for i, f in enumerate(fields)} if with_fields else {"x": {f: 1 for f in fields}}
    checks = gf.datacite_checks(documents(spark, doc))
    assert {r["passed"] for r in checks.collect()} == {with_fields}
    total = gf.fair_scores(checks).filter("principle = 'Total'").first()
    assert (total["passed"], total["total"], total["pct"]) == (19 * with_fields, 19, 100.0 * with_fields)


def test_csv_quotes_and_line_breaks(spark, tmp_path):
    (tmp_path / "q.csv").write_text('a,b,c\n1,"say ""hi"", you","two\nlines"\n2,plain,"x"\n')
    rows = gf.read_csv(spark, str(tmp_path / "q.csv")).collect()
    assert [tuple(r) for r in rows] == [(1, 'say "hi", you', "two\nlines"), (2, "plain", "x")]


def test_csv_headers_in_another_order_are_refused(spark, tmp_path):
    (tmp_path / "1.csv").write_text("x,y\n1,2\n")
    (tmp_path / "2.csv").write_text("y,x\n3,4\n")
    with pytest.raises(Exception, match="(?i)header"):
        gf.read_csv(spark, str(tmp_path)).collect()


def test_csv_types_follow_the_values(spark, tmp_path):
    (tmp_path / "t.csv").write_text(
        "i,x,s,b,none,mixed,d,wide\n"
        "1,1.5,a,True,NA,1,1d,12345678901234567890\n"
        "-2,n/a,NULL,false,,x,2,1\n"
        "nan,1e3,#N/A,,null,3,3,2\n"
    )
    df = gf.read_csv(spark, str(tmp_path))
    assert [f.dataType.simpleString() for f in df.schema.fields] == [
        "bigint", "double", "string", "boolean", "double", "string", "string", "double",
    ]
    assert [tuple(r)[:5] for r in df.collect()] == [
        (1, 1.5, "a", True, None), (-2, None, None, False, None), (None, 1000.0, None, None, None),
    ]
    typed = gf.read_csv(spark, str(tmp_path), schema="i int, x double")
    assert [tuple(r) for r in typed.collect()] == [(1, 1.5), (-2, None), (None, 1000.0)]


def test_missing_tokens_and_question_marks(spark):
    df = spark.createDataFrame([("NA", float("nan"), 1), ("?", 2.0, 2), (" NA", None, 3)], "s string, x double, i int")
    got = [tuple(r) for r in gf.normalize_missing(df).collect()]
    assert got == [(None, None, 1), ("?", 2.0, 2), (" NA", None, 3)]
    assert gf.normalize_missing(df, ["s"], ["?"]).filter("s IS NULL").count() == 1


def test_json_files(spark, tmp_path):
    (tmp_path / "list.json").write_text('[{"a": 1, "b": "x"}, {"a": 2, "c": {"d": [{"e": 1}]}}]')
    got = gf.read_json_rows(spark, str(tmp_path / "list.json"))
    assert got.columns == ["a", "b", "c"] and got.count() == 2
    folder = tmp_path / "objects"
    folder.mkdir()
    (folder / "one.json").write_text(json.dumps({"p": {"q": [{"a": 1, "b": "x"}]}, "r": [{"a": "t"}], "s": [1, 2], "u": 5}))
    (folder / "two.json").write_text(json.dumps({"r": [{"a": "v"}, {"a": "w"}]}))
    got = gf.read_json_rows(spark, str(folder))
    assert sorted((r["a"], r["b"]) for r in got.collect()) == [("1", "x"), ("t", None), ("v", None), ("w", None)]
    with pytest.raises(ValueError, match="no list"):
        gf.json_rows(spark.createDataFrame([(1, [1])], "a int, b array<int>"))


def test_written_files_grow_in_number_not_in_size(spark, tmp_path, monkeypatch):
    from workload import documents as json_queries
    from workload import tables

    docs = spark.range(120).selectExpr("id AS doc_id", "'s' AS source", "concat('a \"q\"\n', id) AS text")
    monkeypatch.setattr(tables, "table", lambda *_: docs.repartition(12))
    monkeypatch.setattr(tables, "new_folder", lambda _: str(tmp_path / "csv"))
    got = tables.csv_quoted(spark, "").collect()
    assert sorted(r["doc_id"] for r in got) == list(range(120)) and {r["source"] for r in got} == {"s"}
    files = list((tmp_path / "csv").glob("part-*"))
    assert len(files) == 12 and all(f.read_text().startswith("doc_id,source,text\n") for f in files)

    orders = spark.range(60_000).selectExpr(
        "id AS o_orderkey", "id + 7 AS o_custkey", "'O' AS o_orderstatus", "'low' AS o_orderpriority"
    )
    monkeypatch.setattr(json_queries, "table", lambda *_: orders)
    monkeypatch.setattr(json_queries, "new_folder", lambda _: str(tmp_path / "json"))
    got = json_queries.json_files(spark, "")
    assert got.where("id % 2 = 0 AND customer = id + 7 AND priority IS NULL").count() == 30_000
    assert got.where("id % 2 = 1 AND customer IS NULL AND priority = 'low'").count() == 30_000
    sizes = [f.read_text().count('"id"') for f in (tmp_path / "json").glob("*/part-*")]
    assert sum(sizes) == 60_000 and max(sizes) <= 5_000


def test_json_keys_and_kept_keys(spark):
    docs = documents(spark, '{"z": 1, "a": [2], "m": {"k": 1}}', "[1]", '"x"')
    got = [tuple(r) for r in gf.json_keys(docs).collect()]
    assert got == [(0, 0, "z"), (0, 1, "a"), (0, 2, "m")]
    df = spark.createDataFrame([(1, 2)], "a int, b int")
    assert gf.keep_keys(df, ["b", "absent", "b"]).columns == ["b"]
    with pytest.raises(ValueError):
        gf.keep_keys(df, ["absent"])


def test_npz_archives(spark, tmp_path):
    for i in range(3):
        np.savez(tmp_path / f"{i}.npz", x=np.arange(2) + i, flat=np.ones((2, 1)), deep=np.arange(8).reshape(2, 2, 2))
    schema = "x bigint, flat double, deep array<double>"
    rows = sorted(tuple(r) for r in gf.read_npz(spark, str(tmp_path), schema).collect())
    assert len(rows) == 6 and rows[0] == (0, 1.0, [0.0, 1.0, 2.0, 3.0])


def test_pickled_arrays_are_refused(spark):
    buffer = io.BytesIO()
    np.savez(buffer, x=np.array([{"a": 1}], dtype=object))
    df = spark.createDataFrame([(bytearray(buffer.getvalue()),)], "content binary")
    with pytest.raises(Exception, match="allow_pickle"):
        gf.decode_npz(df, "x string").collect()


def test_report_and_sinks(spark, tmp_path):
    data = [(i, f"g{i % 3}", float(i % 7), "ab"[i % 2]) for i in range(30)]
    df = spark.createDataFrame(data, "id int, g string, x double, y string")
    report = gf.readiness_report(
        df,
        {
            "summary_statistics": {"columns": ["x"]},
            "completeness": {},
            "outliers": {"columns": ["x"]},
            "overall_outliers": {"columns": ["x"]},
            "correlations": {"columns": ["id", "x", "g", "y"]},
            "feature_relevance": {"target": "x", "categorical": ["g"]},
            "class_distribution": {"column": "g"},
            "imbalance_degree": {"column": "y", "metrics": ["TV"]},
            "representation_rates": {"columns": ["y"]},
            "statistical_rates": {"target": "y", "sensitive": "g"},
            "demographic_disparity": {"target": "y", "sensitive": "g", "accepted": "a"},
            "l_diversity": {"quasi_identifiers": ["g"], "sensitive": "y"},
            "t_closeness": {"quasi_identifiers": ["g"], "sensitive": "y"},
            "attribute_risk": {"id_column": "id", "quasi_identifiers": ["g", "y"]},
            "combination_risk": {"id_column": "id", "quasi_identifiers": ["g", "y"]},
        },
    )
    gf.write_report(report, str(tmp_path / "report"))
    rows = spark.read.schema(report.schema).json(str(tmp_path / "report")).collect()
    values = {(r["metric"], r["subject"], r["key"]): r["value"] for r in rows}
    assert values["summary_statistics", "x", "mean"] == pytest.approx(np.mean([r[2] for r in data]), abs=0.01)
    assert values["statistical_rates", "g0 | a", "rate"] == 0.5
    assert values["demographic_disparity", "g0", "disparity"] == 0.0
    assert all(v is None or round(v, 2) == v for v in values.values())
    for wrong in ({}, {"nope": {}}):
        with pytest.raises(ValueError):
            gf.readiness_report(df, wrong)
    gf.write_table(df, str(tmp_path / "t"), format="csv")
    assert gf.read_csv(spark, str(tmp_path / "t")).count() == 30
    with pytest.raises(ValueError):
        gf.write_table(df, str(tmp_path / "t"), format="xlsx")
