"""A mutable collection of records (id, source, content, title, metadata, ord) as DataFrame merges.

`ord` is the record's place: a replaced record keeps it, a new one goes to the
end.  Functions return the new state; `store.Store` publishes it atomically.
"""

from __future__ import annotations

import json

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import StructType

from ..functions.filters import CORE, compile_filter
from ..schema import DOCUMENT, META, RECORD, text_value
from .numbering import numbered

COLUMNS = ("id", "source", "content", "title", "metadata")


def empty(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], DOCUMENT + ", ord bigint")


def upsert(state: DataFrame, batch: DataFrame, order: Column | str = "src_ord") -> DataFrame:
    """`state` with the records of `batch`; of a repeated id the last by `order` holds, at the place of the first."""
    o = F.col(order) if isinstance(order, str) else order
    new = batch.withColumn("__o", o).groupBy("id").agg(F.max_by(F.struct(*COLUMNS[1:]), "__o").alias("r"), F.min("__o").alias("first"))
    top = state.agg(F.coalesce(F.max("ord"), F.lit(-1)).alias("top"))
    old = state.select("id", F.struct(*COLUMNS[1:]).alias("old"), "ord")
    known = old.join(new, "id", "left").select("id", F.coalesce("r", "old").alias("r"), "ord")
    added = numbered(new.join(old.select("id"), "id", "left_anti"), ["first", "id"], "nth", start=1)
    added = added.crossJoin(F.broadcast(top)).select("id", "r", (F.col("top") + F.col("nth")).alias("ord"))  # one row
    return known.unionByName(added).select("id", *(F.col(f"r.{c}").alias(c) for c in COLUMNS[1:]), "ord")


def select_records(state: DataFrame, source: str | None = None, conditions: dict | None = None) -> DataFrame:
    """Records of a source and a filter, which may name id, source, title and content as well."""
    out = state if source is None else state.where(F.col("source") == source)
    return out.where(compile_filter(conditions, F.col("metadata"), core=True)) if conditions else out


def fetch(state: DataFrame, ids: list[str]) -> DataFrame:
    """Records in the order of `ids`, with `place`; unknown and repeated ids are left out."""
    wanted = state.sparkSession.createDataFrame([(i, k) for k, i in enumerate(dict.fromkeys(ids))], "id string, place int")
    return state.join(wanted, "id").orderBy("place")


def flat_metadata(records: DataFrame) -> DataFrame:
    """Metadata with the core fields among them."""
    core = F.create_map(*(x for c in CORE for x in (F.lit(c), text_value(F.col(c)))))
    return records.select("id", F.map_concat(core, F.map_filter("metadata", lambda k, _: ~k.isin(*CORE))).cast(f"map<string,{META}>").alias("fields"))


def delete(state: DataFrame, ids: list[str] | DataFrame) -> DataFrame:
    gone = ids if isinstance(ids, DataFrame) else state.sparkSession.createDataFrame([(i,) for i in ids], "id string")
    return state.join(gone.select("id").distinct(), "id", "left_anti")


def clear(state: DataFrame, source: str | None = None, conditions: dict | None = None) -> DataFrame:
    """`state` without the records of a source and a filter; without either, nothing is left."""
    if source is None and not conditions:
        return state.where(F.lit(False))
    hit = F.coalesce(F.col("source") == source, F.lit(False)) if source is not None else F.lit(True)
    return state.where(~(hit & compile_filter(conditions, F.col("metadata"), core=True)))


def problems(records: DataFrame) -> DataFrame:
    """(id, problem) of records that break a rule: blank id or source, null title or content, core names in the metadata."""
    blank = lambda c: F.trim(F.coalesce(F.col(c), F.lit(""))) == ""
    reserved = F.size(F.array_intersect(F.map_keys(F.coalesce("metadata", F.expr(f"CAST(map() AS map<string,{META}>)"))), F.array(*map(F.lit, CORE)))) > 0
    problem = F.when(blank("id"), "id must not be blank").when(blank("source"), "source must not be blank").when(F.col("content").isNull(), "content must be text").when(F.col("title").isNull(), "title must be text").when(reserved, "metadata uses a reserved name")
    return records.select("id", problem.alias("problem")).where("problem is not null")


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """A collection saved as JSON lines, metadata with their kinds; a malformed line, a value that is no scalar and a
    reserved name fail the read."""
    from ..sources.raw import read_jsonl

    meta = to_arrow_type(StructType.fromDDL(DOCUMENT)["metadata"].dataType)

    def run(batches):
        for b in batches:
            parsed = [list(metadata_of(json.loads(m)).items()) if m else [] for m in b.column(4).to_pylist()]
            rows = pa.array([[(k, dict(zip(("kind", "s", "d", "cf"), v))) for k, v in m] for m in parsed], meta)
            yield pa.RecordBatch.from_arrays([*(b.column(k) for k in range(4)), rows, b.column(5)], [*COLUMNS, "ord"])

    rows = read_jsonl(spark, path, RECORD)
    return rows.select("id", "source", "content", "title", "metadata", F.col("src_ord").cast("bigint").alias("ord")).mapInArrow(run, DOCUMENT + ", ord bigint")


def scalar(v) -> str | int | float | bool:
    """A metadata value as it was given."""
    return {"int": lambda: int(v["s"]), "float": lambda: float(v["s"]), "bool": lambda: v["s"] == "True"}.get(v["kind"], lambda: v["s"])()


def write_records(state: DataFrame, path: str) -> None:
    """A collection as JSON lines in its order (a folder of files), metadata with their kinds."""
    def run(batches):
        for b in batches:
            lines = [json.dumps({c: r[c] for c in COLUMNS[:4]} | {"metadata": {k: scalar(v) for k, v in r["metadata"] or []}}, ensure_ascii=False) for r in b.to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(lines, pa.string())], ["value"])

    state.repartitionByRange("ord").sortWithinPartitions("ord").select(*COLUMNS).mapInArrow(run, "value string").write.mode("overwrite").text(path)


def metadata_of(fields: dict) -> dict:
    """A metadata mapping of scalars as rows of the metadata type; other values and reserved names are errors."""
    out = {}
    for k, v in fields.items():
        if not isinstance(k, str) or not k or k in CORE:
            raise ValueError(f"metadata name {k!r} is reserved or empty")
        if not isinstance(v, (str, int, float, bool)):
            raise TypeError(f"metadata value of {k!r} must be a scalar, not {type(v).__name__}")
        kind = type(v).__name__
        out[k] = (kind, str(v), None if kind == "str" else float(v), str(v).casefold())
    return out


def records_of(spark: SparkSession, items: list[dict]) -> DataFrame:
    """Records of mappings (id, source, content, title, metadata), validated, with src_ord."""
    rows = []
    for n, r in enumerate(items):
        for f in ("id", "source"):
            if not isinstance(r.get(f), str) or not r[f].strip():
                raise ValueError(f"record {n}: {f} must be text that is not blank")
        for f in ("content", "title"):
            if not isinstance(r.get(f, ""), str):
                raise TypeError(f"record {n}: {f} must be text")
        rows.append((r["id"], r["source"], r.get("content", ""), r.get("title", ""), metadata_of(r.get("metadata", {})), n))
    return spark.createDataFrame(rows, DOCUMENT + ", src_ord bigint")
