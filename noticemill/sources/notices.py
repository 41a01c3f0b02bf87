"""Reading notices: JSON and Parquet, corrupt records, envelopes, documents."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..functions.dates import parse_date

_ENTITY = "array<struct<description:string>>"
RAW = "id string, contractDesignation string, description string, contractingEntities " + _ENTITY + ", contractingEntity string, entity string, entityName string, contractingEntityName string, contractingProcedureType string, contractType string, modelType string, type string, cpvs array<string>, basePrice string, proposalDeadline string, drPublicationDate string, announcementNumber string, reference string, contractingProcedureUrl string, contractingProcedureId string"


def read_notices(spark: SparkSession, path: str) -> DataFrame:
    """Notices of an envelope {"items": [...]} per line, one row each."""
    rows = spark.read.schema(f"items array<struct<{RAW.replace(' string', ':string').replace(' array', ':array')}>>").json(path)
    return rows.select(F.inline("items"))


def read_checkpoint(spark: SparkSession, path: str, schema: StructType, strict: bool = False) -> DataFrame:
    """Records of a JSON array file. A missing file or a corrupt record gives none, or fails if strict."""
    try:
        return spark.read.schema(schema).option("mode", "FAILFAST" if strict else "DROPMALFORMED").option("multiLine", True).json(path)
    except AnalysisException as e:
        if strict or e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


def write_notices(df: DataFrame, path: str) -> None:
    """All results as JSON, one object a line, null fields kept."""
    df.write.option("ignoreNullFields", False).json(path)


def cleaned_payload(c: Column) -> Column:
    """A response body without parentheses around it, as VARIANT; null if it is no JSON object."""
    v = F.try_parse_json(F.regexp_replace(F.trim(c), r"(?s)^\((.*)\);?$", "$1"))
    return F.when(_is_object(v), v)


def _is_object(v: Column) -> Column:
    return F.coalesce(F.schema_of_variant(v).like("OBJECT%"), F.lit(False))


def unwrapped(v: Column) -> Column:
    """The detail object in an envelope: the first of item, data, result, resultado that is an object, else the first of items, else v."""
    inner = lambda path: F.try_variant_get(v, path, "variant")
    tried = [F.when(_is_object(inner(f"$.{k}")), inner(f"$.{k}")) for k in ("item", "data", "result", "resultado")]
    return F.coalesce(*tried, F.when(_is_object(inner("$.items[0]")), inner("$.items[0]")), v)


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """(path, content) of files that begin as PDF."""
    files = spark.read.format("binaryFile").load(path)
    return files.where(F.startswith("content", F.lit(b"%PDF"))).select("path", "content")


def allowed_host(url: Column, hosts: list[str]) -> Column:
    return F.coalesce(F.try_parse_url(url, F.lit("HOST")).isin(hosts), F.lit(False)) & F.startswith(url, F.lit("https://"))


def recent(df: DataFrame, as_of: Column, days: int = 7, column: str = "data") -> DataFrame:
    """Rows published in the last days; undated ones stay."""
    published = parse_date(F.col(column), "collector")
    return df.where(published.isNull() | (published >= F.date_sub(as_of, days)))


def stored_relevant(df: DataFrame) -> DataFrame:
    """Null counts as relevant."""
    return df.where(F.coalesce("relevante", F.lit(1)) == 1)
