"""Kinds of objects in a dataset, in text form and as Spark types.

STRING; VECTOR:dims:TYPE; MULTIOBJECT:n:(..):(..); CUSTOM:id.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import types as T

from sembla.functions.strings import split_brackets

# Element types by name; unsigned ones are widened, as Spark has none.
ELEMENTS: dict[str, T.DataType] = {
    "INT8": T.ByteType(), "INT16": T.ShortType(), "INT32": T.IntegerType(), "INT64": T.LongType(), "UINT8": T.ShortType(), "UINT16": T.IntegerType(), "UINT32": T.LongType(), "UINT64": T.DecimalType(20, 0), "FLOAT": T.FloatType(), "DOUBLE": T.DoubleType(),
}


@dataclass(frozen=True)
class Domain:
    """What an object is: kind, dims and element of a vector, parts of a multi-object, id of a custom one."""

    kind: str
    dims: int = 0
    element: str = ""
    parts: tuple[Domain, ...] = field(default=())
    custom: str = ""

    def __str__(self) -> str:
        if self.kind == "VECTOR":
            return f"VECTOR:{self.dims}:{self.element}"
        if self.kind == "MULTIOBJECT":
            return f"MULTIOBJECT:{len(self.parts)}:" + ":".join(f"({p})" for p in self.parts)
        return f"CUSTOM:{self.custom}" if self.kind == "CUSTOM" else self.kind

    def matches(self, other: Domain, element: bool = True) -> bool:
        """Equal kinds, dims and (if element) element types."""
        if self.kind != other.kind or self.dims != other.dims or self.custom != other.custom or len(self.parts) != len(other.parts):
            return False
        return (not element or self.element == other.element) and all(a.matches(b, element) for a, b in zip(self.parts, other.parts))

    def spark_type(self) -> T.DataType:
        """The column type of such objects."""
        if self.kind == "STRING":
            return T.StringType()
        if self.kind == "VECTOR":
            return T.ArrayType(ELEMENTS[self.element], False)
        if self.kind == "MULTIOBJECT":
            return T.StructType([T.StructField(f"part{i}", p.spark_type()) for i, p in enumerate(self.parts)])
        return T.BinaryType()


def parse_domain(text: str) -> Domain:
    """The domain of a text form; ValueError if it is none."""
    kind, *rest = split_brackets(text.strip(), ":")
    kind = kind.upper()
    if kind == "STRING" and not rest:
        return Domain("STRING")
    if kind == "VECTOR" and len(rest) == 2 and rest[1].upper() in ELEMENTS and int(rest[0]) > 0:
        return Domain("VECTOR", int(rest[0]), rest[1].upper())
    if kind == "MULTIOBJECT" and rest and len(rest) == int(rest[0]) + 1:
        return Domain("MULTIOBJECT", parts=tuple(parse_domain(p[1:-1]) for p in rest[1:]))
    if kind == "CUSTOM" and len(rest) == 1:
        return Domain("CUSTOM", custom=rest[0])
    raise ValueError(f"no domain: {text!r}")
