"""FAIR checks over collections of JSON metadata documents.

Input is a table ``(doc_id, doc)`` with one JSON text per row and unique ids.
All checks are row-wise: a document never meets another and nothing is shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.checks import require_columns

# The fields of each principle for DCAT documents, in order.
DCAT_FIELDS = {
    "Findable": ("identifier", "title", "description", "keyword", "theme", "landingPage"),
    "Accessible": (
        "accessLevel", "downloadURL", "mediaType", "accessURL", "issued", "modified",
    ),
    "Interoperable": (
        "conformsTo", "references", "language", "format", "spatial", "temporal",
    ),
    "Reusable": (
        "license", "rights", "publisher", "description", "format", "programCode",
        "bureauCode", "contactPoint",
    ),
}

# The top-level fields of each principle for DataCite documents.
DATACITE_FIELDS = {
    "Findable": (
        "identifiers", "creators", "titles", "publisher", "publicationYear",
        "subjects", "alternateIdentifiers", "relatedIdentifiers", "descriptions",
        "schemaVersion",
    ),
    "Accessible": ("contributors",),
    "Interoperable": ("geoLocations",),
    "Reusable": (
        "dates", "language", "sizes", "formats", "version", "rightsList",
        "fundingReferences",
    ),
}


def document_status(docs: DataFrame) -> DataFrame:
    """``(doc_id, status)``: ``ok`` for a JSON object, else ``invalid``.

    Flattening, checks and scores leave invalid documents out.
    """
    require_columns(docs, ["doc_id", "doc"], "document column")
    return docs.select("doc_id", F.when(_is_object(), "ok").otherwise("invalid").alias("status"))


def _is_object() -> Column:
    return _holds(F.try_parse_json("doc"), "map<string,variant>")


def _holds(value: Column, container: str) -> Column:
    """Whether a variant is an object or a list; looks at its outermost level only."""
    return F.try_variant_get(value, "$", container).isNotNull()


_NODES = "array<struct<key:string,value:string,kind:string>>"


def flatten_documents(docs: DataFrame, max_depth: int | None = None) -> DataFrame:
    """``(doc_id, ord, key, value)``: the leaves of every document, in its order.

    Keys are joined by ``_`` and list items numbered from 1; items of a list that
    are lists themselves stay one leaf, empty containers have none. If two paths
    give one key, the first place and the last value count. Documents may have any
    depth; with ``max_depth`` a document that has containers below it is an error.
    """
    # the outer form: else the optimizer evaluates the array twice, for a filter on its size
    return (
        _objects(docs)
        .select("doc_id", F.posexplode_outer(_leaves(max_depth)).alias("ord", "leaf"))
        .filter(F.col("leaf").isNotNull())
        .select("doc_id", "ord", F.col("leaf.key").alias("key"), F.col("leaf.value").alias("value"))
    )


def _objects(docs: DataFrame) -> DataFrame:
    require_columns(docs, ["doc_id", "doc"], "document column")
    return docs.filter(_is_object()).select("doc_id", "doc")


def _let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _leaves(max_depth: int | None) -> Column:
    """All leaves of a document as one array; no key twice.

    A list of nodes, at first the document alone, is walked level by level: each step
    puts the children of every container in its place, until none is left. There are
    at most as many steps as opening brackets, and those after the last level do nothing.
    """
    root = F.array(
        F.struct(
            F.lit(None).cast("string").alias("key"),
            F.col("doc").alias("value"),
            F.lit("object").alias("kind"),
        )
    )
    start = F.struct(root.cast(_NODES).alias("nodes"), F.lit(True).alias("open"))

    def step(state: Column, _) -> Column:
        below = F.flatten(
            F.transform(
                state["nodes"],
                lambda n: F.when(n["kind"] == "leaf", F.array(n)).otherwise(
                    F.coalesce(_children(n), F.array().cast(_NODES))
                ),
            )
        )
        deeper = _let(
            below,
            lambda nodes: F.struct(
                nodes.alias("nodes"), F.exists(nodes, lambda n: n["kind"] != "leaf").alias("open")
            ),
        )
        return F.when(state["open"], deeper).otherwise(state)

    steps = F.regexp_count("doc", F.lit(r"[{\[]"))
    if max_depth is None:
        return F.aggregate(
            F.sequence(F.lit(1), steps), start, step, lambda state: _last_of_each_key(state["nodes"])
        )
    error = F.raise_error(F.lit(f"document nested deeper than {max_depth} levels"))
    return F.aggregate(
        F.sequence(F.lit(1), F.least(steps, F.lit(max_depth))),
        start,
        step,
        lambda state: F.when(state["open"], error.cast(_NODES)).otherwise(
            _last_of_each_key(state["nodes"])
        ),
    )


def _last_of_each_key(nodes: Column) -> Column:
    def last(keys: Column) -> Column:
        of_key = F.transform(
            F.array_distinct(keys),
            lambda key: F.element_at(F.filter(nodes, lambda leaf: leaf["key"] == key), -1),
        )
        return F.when(F.size(F.array_distinct(keys)) == F.size(keys), nodes).otherwise(of_key)

    return _let(F.transform(nodes, lambda leaf: leaf["key"]), last)


def _children(node: Column) -> Column:
    """Entries of a container as ``(key, value, kind)``, in document order.

    Parsing into texts keeps the order of keys and the source of nested parts. Texts that
    begin like a container may be strings: those are told by variants, for which the
    container is parsed again, only if it has such texts.
    """
    text = node["value"]

    def entry(key: Column, value: Column, kind: Column | None = None) -> Column:
        return F.struct(
            F.concat_ws("_", node["key"], key).alias("key"),
            value.alias("value"),
            (F.lit("leaf") if kind is None else kind).alias("kind"),
        )

    def kind(value: Column, typed: Column, nested: tuple[str, ...]) -> Column:
        out = F.lit("leaf")
        for container, first, shape in (
            ("object", "{", "map<string,variant>"),
            ("array", "[", "array<variant>"),
        ):
            if container in nested:
                out = F.when(
                    F.startswith(value, F.lit(first)) & _holds(typed, shape), F.lit(container)
                ).otherwise(out)
        return out

    def fields(found: Column) -> Column:
        typed = F.map_values(F.from_json(text, "map<string,variant>"))
        checked = F.transform(
            F.arrays_zip(found.alias("entry"), typed.alias("typed")),
            lambda f: entry(
                f["entry"]["key"],
                f["entry"]["value"],
                kind(f["entry"]["value"], f["typed"], ("object", "array")),
            ),
        )
        plain = F.transform(found, lambda f: entry(f["key"], f["value"]))
        nested = F.exists(found, lambda f: f["value"].startswith("{") | f["value"].startswith("["))
        return F.when(nested, checked).otherwise(plain)

    def items(found: Column) -> Column:
        typed = F.from_json(text, "array<variant>")
        checked = F.transform(
            F.arrays_zip(found.alias("value"), typed.alias("typed")),
            lambda f, i: entry(
                (i + 1).cast("string"), f["value"], kind(f["value"], f["typed"], ("object",))
            ),
        )
        plain = F.transform(found, lambda f, i: entry((i + 1).cast("string"), f))
        return F.when(F.exists(found, lambda f: f.startswith("{")), checked).otherwise(plain)

    return F.when(
        node["kind"] == "object",
        _let(F.map_entries(F.from_json(text, "map<string,string>")), fields),
    ).otherwise(_let(F.from_json(text, "array<string>"), items))


def dcat_checks(docs: DataFrame, max_depth: int | None = None) -> DataFrame:
    """``(doc_id, principle, field, matched_key, value, passed)``: 26 rows per document.

    Fields claim keys in order; each takes the first free key that equals it, with
    or without a trailing number, or ends with it. No field name ends with
    another, so a key can only match one field, and the second use of a field
    simply takes its second key.
    """
    slots, _ = _dcat_slots()

    def rows(claims: Column) -> Column:
        out = []
        for principle, field, use in slots:
            hit = F.get(claims[field], F.lit(use - 1))
            out.append(
                F.struct(
                    F.lit(principle).alias("principle"),
                    F.lit(field).alias("field"),
                    hit["key"].alias("matched_key"),
                    hit["value"].alias("value"),
                    hit.isNotNull().alias("passed"),
                )
            )
        return F.array(*out)

    found = _let(_claims(_matched(_leaves(max_depth))), rows)
    return _objects(docs).select("doc_id", F.explode_outer(found).alias("c")).select("doc_id", "c.*")


def other_keys(docs: DataFrame, max_depth: int | None = None) -> DataFrame:
    """``(doc_id, key, value)``: the leaves that no DCAT field claims."""
    _, uses = _dcat_slots()

    def free(leaves: Column) -> Column:
        def unclaimed(claims: Column) -> Column:
            taken = F.flatten(
                F.array(
                    *[
                        F.transform(F.slice(claims[field], 1, n), lambda leaf: leaf["key"])
                        for field, n in uses.items()
                    ]
                )
            )
            return _let(
                taken,
                lambda keys: F.filter(leaves, lambda leaf: ~F.array_contains(keys, leaf["key"])),
            )

        return _let(_claims(_matched(leaves)), unclaimed)

    return (
        _objects(docs)
        .select("doc_id", F.explode_outer(_let(_leaves(max_depth), free)).alias("leaf"))
        .filter(F.col("leaf").isNotNull())
        .select("doc_id", F.col("leaf.key").alias("key"), F.col("leaf.value").alias("value"))
    )


def dcat_scores(docs: DataFrame, max_depth: int | None = None) -> DataFrame:
    """``(doc_id, principle, passed, failed, total, pct)``: :func:`fair_scores` of the DCAT checks,
    counted inside the row of a document.
    """
    slots, uses = _dcat_slots()

    def scores(claims: Column) -> Column:
        return _score_rows(
            {
                principle: [F.size(claims[f]) >= use for p, f, use in slots if p == principle]
                for principle in DCAT_FIELDS
            }
        )

    found = _let(_claims(_matched(_leaves(max_depth))), scores)
    return _objects(docs).select("doc_id", F.explode_outer(found).alias("s")).select("doc_id", "s.*")


def datacite_scores(docs: DataFrame) -> DataFrame:
    """``(doc_id, principle, passed, failed, total, pct)``: :func:`fair_scores` of the DataCite
    checks, counted inside the row of a document.
    """

    def scores(keys: Column) -> Column:
        return _score_rows(
            {
                principle: [F.array_contains(keys, F.lit(f)) for f in fields]
                for principle, fields in DATACITE_FIELDS.items()
            }
        )

    found = _let(F.json_object_keys("doc"), scores)
    return _objects(docs).select("doc_id", F.explode_outer(found).alias("s")).select("doc_id", "s.*")


def _score_rows(tests: dict[str, list[Column]]) -> Column:
    """A row for each principle and one for all, as an array."""
    groups = {**tests, "Total": [t for group in tests.values() for t in group]}
    rows = []
    for name, group in groups.items():
        passed = F.lit(0).cast("bigint")
        for test in group:
            passed = passed + F.coalesce(test, F.lit(False)).cast("bigint")
        rows.append(F.struct(F.lit(name).alias("principle"), passed.alias("n"), F.lit(len(group)).alias("of")))

    def scored(r: Column) -> Column:
        total = r["of"].cast("bigint")
        return F.struct(
            r["principle"].alias("principle"),
            r["n"].alias("passed"),
            (total - r["n"]).alias("failed"),
            total.alias("total"),
            (r["n"] * F.lit(100.0) / total).alias("pct"),
        )

    return F.transform(F.array(*rows), scored)


def _matched(leaves: Column) -> Column:
    """Leaves that match a DCAT field, with the field."""
    named = F.transform(
        leaves,
        lambda leaf: F.struct(
            leaf["key"].alias("key"),
            leaf["value"].alias("value"),
            _matched_field(leaf["key"]).alias("field"),
        ),
    )
    return F.filter(named, lambda leaf: leaf["field"].isNotNull())


def _claims(matched: Column) -> Column:
    """For every DCAT field the leaves that match it, in order, as a map."""
    _, uses = _dcat_slots()

    def of_field(found: Column, field: str) -> Column:
        return F.filter(found, lambda leaf: leaf["field"] == F.lit(field))

    return _let(
        matched,
        lambda found: F.create_map(
            *[part for field in uses for part in (F.lit(field), of_field(found, field))]
        ),
    )


def _dcat_slots() -> tuple[list[tuple[str, str, int]], dict[str, int]]:
    """(principle, field, which use of the field this is), and uses per field."""
    slots: list[tuple[str, str, int]] = []
    uses: dict[str, int] = {}
    for principle, fields in DCAT_FIELDS.items():
        for field in fields:
            uses[field] = uses.get(field, 0) + 1
            slots.append((principle, field, uses[field]))
    return slots, uses


def _matched_field(key: Column) -> Column:
    """The DCAT field a key stands for, or NULL."""
    fields = list(dict.fromkeys(f for group in DCAT_FIELDS.values() for f in group))

    def first(base: Column) -> Column:
        found = F.lit(None).cast("string")
        for field in reversed(fields):
            hit = (base == F.lit(field)) | F.endswith(key, F.lit(field))
            found = F.when(hit, F.lit(field)).otherwise(found)
        return found

    return _let(F.regexp_replace(key, r"_\d+$", ""), first)


def datacite_checks(docs: DataFrame) -> DataFrame:
    """``(doc_id, principle, field, matched_key, value, passed)``: 19 rows per document.

    A field passes if it is a top-level key, whatever its value. Row-wise.
    """
    require_columns(docs, ["doc_id", "doc"], "document column")
    wanted = F.array(
        *[
            F.struct(F.lit(principle).alias("principle"), F.lit(field).alias("field"))
            for principle, fields in DATACITE_FIELDS.items()
            for field in fields
        ]
    )
    found = F.map_contains_key("fields", F.col("field"))
    passed = F.coalesce(found, F.lit(False))
    return (
        docs.filter(_is_object())
        .select("doc_id", F.from_json("doc", "map<string,string>").alias("fields"))
        .select("doc_id", "fields", F.inline(wanted))
        .select(
            "doc_id",
            "principle",
            "field",
            F.when(passed, F.col("field")).alias("matched_key"),
            F.col("fields")[F.col("field")].alias("value"),
            passed.alias("passed"),
        )
    )


def fair_scores(checks: DataFrame) -> DataFrame:
    """``(doc_id, principle, passed, failed, total, pct)`` per principle and for ``Total``."""
    by_document = F.grouping("principle") == 1
    return checks.groupingSets(
        [["doc_id", "principle"], ["doc_id"]], "doc_id", "principle"
    ).agg(
        F.count_if("passed").alias("passed"),
        F.count("*").alias("total"),
        F.when(by_document, F.lit("Total")).otherwise(F.col("principle")).alias("scope"),
    ).select(
        "doc_id",
        F.col("scope").alias("principle"),
        "passed",
        (F.col("total") - F.col("passed")).alias("failed"),
        "total",
        (F.col("passed") * F.lit(100.0) / F.col("total")).alias("pct"),
    )
