"""The stored schema and its additive evolution."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, LongType, StringType, StructField, StructType

_TEXT = ["data_limite", "preco_base", "cpv", "tipo_procedimento", "link_anuncio_dr", "data_entrega_propostas", "criterio_tipo", "criterio_resumo", "criterio_detalhe", "entregaveis"]
#: Where a notice is from: shown and searched, not given by the collector.
PLACE = ["distrito", "municipio"]
STORED = StructType(
    [
        StructField("id", LongType(), False),
        StructField("titulo", StringType(), False),
        StructField("entidade", StringType()),
        StructField("link", StringType(), False),
        StructField("data", StringType()),
        StructField("relevante", IntegerType()),
        *(StructField(c, StringType()) for c in _TEXT),
        *(StructField(c, StringType()) for c in PLACE),
    ]
)
#: Columns that an update fills in where it has a value.
ENRICHED = ["titulo", "entidade", "data", *_TEXT]


def align(df: DataFrame, schema: StructType = STORED) -> DataFrame:
    """df with exactly the schema's columns: missing ones null, others cast, further ones dropped."""
    return df.select(*((F.col(f.name) if f.name in df.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in schema))
