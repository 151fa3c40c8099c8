"""Readers that need more than ``spark.read``."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from urllib.parse import unquote

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.expressions import MISSING_TOKENS, ref
from ..plans.checks import require_columns
from .missing import normalize_missing

WHOLE_NUMBER = r"^\s*[+-]?\d{1,18}\s*$"
NUMBER = r"^\s*[+-]?((\d+\.?\d*|\.\d+)([eE][+-]?\d+)?|[iI]nf(inity)?)\s*$"


def read_csv(
    spark: SparkSession,
    path: str | list[str],
    schema: T.StructType | str | None = None,
    multi_line: bool = True,
) -> DataFrame:
    """CSV with a header row and the usual missing tokens.

    A quote inside quotes is doubled. Fields may hold line breaks; files without
    any are split among tasks with ``multi_line=False``. All files must have the
    columns of the first in its order, else the read fails.

    With a schema the files are read once, tokens included. Without one all
    columns are read as text, tokens become NULL, and one aggregate finds out
    which columns hold numbers or booleans.
    """
    raw = spark.read.csv(
        path,
        header=True,
        inferSchema=False,
        quote='"',
        escape='"',
        multiLine=multi_line,
        enforceSchema=False,
    )
    text = normalize_missing(raw, raw.columns, MISSING_TOKENS)
    if schema is not None:
        wanted = schema if isinstance(schema, T.StructType) else T.StructType.fromDDL(schema)
        require_columns(text, wanted.fieldNames())
        return text.select(
            *[F.trim(ref(f.name)).cast(f.dataType).alias(f.name)
              if not isinstance(f.dataType, T.StringType) else ref(f.name)
              for f in wanted.fields]
        )
    fits = text.agg(
        *[
            F.struct(
                F.count(ref(c)).alias("n"),
                F.count_if(ref(c).rlike(WHOLE_NUMBER)).alias("whole"),
                F.count_if(ref(c).rlike(NUMBER)).alias("number"),
                F.count_if(F.lower(ref(c)).isin("true", "false")).alias("truth"),
            ).alias(f"f{i}")
            for i, c in enumerate(text.columns)
        ]
    ).first()
    return text.select(
        *[_typed(ref(c), fits[i]).alias(c) for i, c in enumerate(text.columns)]
    )


def _typed(column, fit):
    if fit["n"] == 0:
        return column.cast("double")
    if fit["whole"] == fit["n"]:
        return F.trim(column).cast("bigint")
    if fit["number"] == fit["n"]:
        return F.trim(column).cast("double")
    if fit["truth"] == fit["n"]:
        return column.cast("boolean")
    return column


def read_json_rows(
    spark: SparkSession, path: str | list[str], top_level: str = "auto"
) -> DataFrame:
    """Rows of the lists in JSON documents, one document per file.

    Files that are a list (``top_level="list"``) give its objects as rows, files
    that are an object are searched for lists (``json_rows``). ``auto`` decides
    file by file; columns whose types differ between both kinds become text.
    """
    if top_level not in ("auto", "list", "object"):
        raise ValueError("top_level must be auto, list or object")
    if top_level == "auto":
        start = F.substring(F.ltrim(F.col("value")), 1, 1)
        files = spark.read.text(path, wholetext=True).select(
            F.col("_metadata.file_path").alias("file"), (start == "[").alias("is_list")
        )
        found = [(unquote(row["file"]), row["is_list"]) for row in files.collect()]
        parts = [
            read_json_rows(spark, chosen, kind)
            for kind in ("list", "object")
            if (chosen := [file for file, is_list in found if is_list == (kind == "list")])
        ]
        return _united(parts)
    docs = spark.read.json(path, multiLine=True)
    return docs if top_level == "list" else json_rows(docs)


def _united(parts: list[DataFrame]) -> DataFrame:
    if not parts:
        raise ValueError("no file found")
    kinds: dict[str, set[str]] = {}
    for part in parts:
        for f in part.schema.fields:
            kinds.setdefault(f.name, set()).add(f.dataType.simpleString())
    mixed = [name for name, seen in kinds.items() if len(seen) > 1]
    parts = [p.withColumns({c: ref(c).cast("string") for c in mixed if c in p.columns}) for p in parts]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part, allowMissingColumns=True)
    return out


def read_documents(
    spark: SparkSession,
    path: str | list[str],
    max_bytes: int = 1 << 28,
    recursive: bool = False,
) -> DataFrame:
    """``(doc_id, doc, status)`` of metadata files, one document each; ``doc_id`` is the path.

    ``status`` is ``ok`` for a JSON object, ``invalid`` for other text, ``not text`` for bytes
    that are no UTF-8 and ``too large`` beyond ``max_bytes``; only an ``ok`` document is what
    the FAIR checks score. A file that cannot be used has a row like any other, so it stops
    nothing; only files of no bytes have none, as Spark does not list them. Tasks read the files.
    ``recursive`` reads the files of all levels below a folder, many folders listed at a time;
    a pattern such as ``*/*.json`` is followed by the driver alone, folder by folder.
    """
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", recursive)
    files = reader.load(path).select("path", "length", "content")
    small = F.col("length") <= max_bytes
    text = F.try_validate_utf8(F.when(small, F.col("content")).cast("string"))
    doc = F.regexp_replace(text, "^\ufeff", "")
    known = files.select(
        F.col("path").alias("doc_id"), doc.alias("doc"), small.alias("small")
    )
    judged = F.try_variant_get(F.try_parse_json("doc"), "$", "map<string,variant>").isNotNull()
    return known.select(
        "doc_id",
        "doc",
        F.when(~F.col("small"), "too large")
        .when(F.col("doc").isNull(), "not text")
        .when(F.coalesce(judged, F.lit(False)), "ok")
        .otherwise("invalid")
        .alias("status"),
    )


def json_rows(docs: DataFrame) -> DataFrame:
    """Every object inside a list becomes a row; rows of all lists are united by name.

    Lists are looked for through nested objects, not inside the rows found.
    Lists of scalars and scalar fields give nothing. Columns whose types differ
    between lists become text.
    """
    lists = {path: item for path, item in _lists(docs.schema, ())}
    if not lists:
        raise ValueError("no list of objects found")
    types: dict[str, set[str]] = {}
    for item in lists.values():
        for f in item.fields:
            types.setdefault(f.name, set()).add(f.dataType.simpleString())
    united = {name: seen.pop() if len(seen) == 1 else "string" for name, seen in types.items()}

    def row_of(item: T.StructType):
        own = set(item.fieldNames())
        return lambda r: F.struct(
            *[
                (r.getField(name) if name in own else F.lit(None)).cast(kind).alias(name)
                for name, kind in united.items()
            ]
        )

    # one array of all rows, so that the documents are read once
    shape = "array<struct<" + ",".join(f"`{n}`:{k}" for n, k in united.items()) + ">>"
    rows = [
        F.coalesce(
            F.transform(F.filter(_at(path), lambda r: r.isNotNull()), row_of(item)),
            F.array().cast(shape),
        )
        for path, item in lists.items()
    ]
    return docs.select(F.explode_outer(F.concat(*rows)).alias("r")).filter(
        F.col("r").isNotNull()
    ).select("r.*")


def _at(path: tuple[str, ...]) -> Column:
    column = ref(path[0])
    for name in path[1:]:
        column = column.getField(name)
    return column


def _lists(
    schema: T.StructType, prefix: tuple[str, ...]
) -> Iterator[tuple[tuple[str, ...], T.StructType]]:
    """Lists of objects, with their element type, reached through objects only."""
    for f in schema.fields:
        if isinstance(f.dataType, T.StructType):
            yield from _lists(f.dataType, (*prefix, f.name))
        elif isinstance(f.dataType, T.ArrayType):
            if isinstance(f.dataType.elementType, T.StructType):
                yield (*prefix, f.name), f.dataType.elementType


def json_keys(docs: DataFrame, column: str = "doc") -> DataFrame:
    """``(*other columns, ordinal, key)``: top-level keys of JSON texts, in their order.

    A text that is not an object has no keys and gives no row.
    """
    require_columns(docs, [column])
    others = [ref(c) for c in docs.columns if c != column]
    return docs.select(
        *others, F.posexplode(F.json_object_keys(ref(column))).alias("ordinal", "key")
    )


def keep_keys(docs: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Keeps the chosen top-level fields; unknown names are ignored."""
    kept = [k for k in dict.fromkeys(keys) if k in docs.columns]
    if not kept:
        raise ValueError("none of the keys is in the documents")
    return docs.select(*[ref(k) for k in kept])


def read_npz(spark: SparkSession, path: str | list[str], schema: T.StructType | str) -> DataFrame:
    """Rows of NumPy archives, many files at a time; every array is a column.

    Arrays of shape (n, 1) become plain columns, other n-d arrays one flat
    list per row, so declare those as ``array<double>``.
    """
    files = spark.read.format("binaryFile").load(path).select("content")
    return decode_npz(files, schema)


def decode_npz(archives: DataFrame, schema: T.StructType | str) -> DataFrame:
    """As ``read_npz``, from a table with the bytes of one archive per row."""
    wanted = schema if isinstance(schema, T.StructType) else T.StructType.fromDDL(schema)
    names = wanted.fieldNames()

    def rows_of(batches):
        import io

        import numpy as np
        import pandas as pd

        for batch in batches:
            for content in batch["content"]:
                # pickled arrays are refused: they could run code
                with np.load(io.BytesIO(content), allow_pickle=False) as archive:
                    columns = {}
                    for name in names:
                        values = archive[name]
                        if values.ndim == 2 and values.shape[1] == 1:
                            values = values.ravel()
                        if values.ndim > 1:
                            values = list(values.reshape(len(values), -1))
                        columns[name] = values
                    yield pd.DataFrame(columns)

    return archives.select("content").mapInPandas(rows_of, wanted)
