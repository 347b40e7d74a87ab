"""Explicit schemas; nothing is inferred."""

from pyspark.sql.types import ArrayType, DataType, DoubleType, IntegerType, LongType, StringType, StructField, StructType


def _struct(**fields: DataType) -> StructType:
    return StructType([StructField(name, kind) for name, kind in fields.items()])


EDGES = _struct(id=IntegerType(), src=IntegerType(), dst=IntegerType())
CUTS = _struct(line_no=LongType(), edges=ArrayType(IntegerType()))
NAMES = _struct(id=IntegerType(), u=IntegerType(), v=IntegerType(), name=StringType())
RUNTIME_LOG = _struct(stage=IntegerType(), ms=LongType(), bonds=LongType())
PATH_LOG = _struct(stage=IntegerType(), level=IntegerType(), len=IntegerType())
GRID = _struct(k=IntegerType(), m=IntegerType(), secs=DoubleType(), bonds=LongType())
NONCANONICITY = _struct(k=IntegerType(), m=IntegerType(), noncan=LongType(), can=LongType())
