"""Message declarations: numbered typed fields and their Spark types."""

from __future__ import annotations

from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import types as T

VARINT, FIXED64, BYTES, GROUP, END_GROUP, FIXED32 = 0, 1, 2, 3, 4, 5

#: Wire type and Spark type of every scalar kind.
SCALARS: dict[str, tuple[int, T.DataType]] = {
    "bool": (VARINT, T.BooleanType()),
    "int32": (VARINT, T.IntegerType()),
    "int64": (VARINT, T.LongType()),
    "uint32": (VARINT, T.LongType()),
    "uint64": (VARINT, T.DecimalType(20, 0)),
    "sint32": (VARINT, T.IntegerType()),
    "sint64": (VARINT, T.LongType()),
    "fixed32": (FIXED32, T.LongType()),
    "sfixed32": (FIXED32, T.IntegerType()),
    "float": (FIXED32, T.FloatType()),
    "fixed64": (FIXED64, T.DecimalType(20, 0)),
    "sfixed64": (FIXED64, T.LongType()),
    "double": (FIXED64, T.DoubleType()),
    "string": (BYTES, T.StringType()),
    "bytes": (BYTES, T.BinaryType()),
}


@dataclass(frozen=True)
class Enum:
    """An open int32 with names; the first name given for a number is its name."""

    name: str
    values: tuple[tuple[str, int], ...]

    def labels(self) -> dict[int, str]:
        found: dict[int, str] = {}
        for label, number in self.values:
            found.setdefault(number, label)
        return found


@dataclass(frozen=True)
class Field:
    """One numbered field. ``kind`` is a scalar name, an :class:`Enum` or a
    :class:`Message`; ``map_key`` makes it a map from that scalar kind to ``kind``."""

    number: int
    name: str
    kind: Any
    repeated: bool = False
    map_key: str | None = None
    required: bool = False
    default: Any = None

    @property
    def is_message(self) -> bool:
        return isinstance(self.kind, Message)

    @property
    def is_single(self) -> bool:
        return not self.repeated and self.map_key is None

    @property
    def scalar(self) -> str:
        """The scalar kind that stands for the value on the wire."""
        return "int32" if isinstance(self.kind, Enum) else self.kind

    @property
    def wire(self) -> int:
        """Wire type of one value."""
        return BYTES if self.is_message else SCALARS[self.scalar][0]

    @property
    def packable(self) -> bool:
        """Whether a list of more than one value is written as one block. Enum lists are
        written value by value."""
        return self.repeated and self.wire != BYTES and not isinstance(self.kind, Enum)

    def value_type(self) -> T.DataType:
        return self.kind.schema() if self.is_message else SCALARS[self.scalar][1]

    def spark_type(self) -> T.DataType:
        if self.map_key is not None:
            return T.MapType(SCALARS[self.map_key][1], self.value_type())
        return T.ArrayType(self.value_type()) if self.repeated else self.value_type()

    def entry(self) -> "Message":
        """The entry message of a map field."""
        key = Field(1, "key", self.map_key, required=True)
        return Message("entry", (key, Field(2, "value", self.kind, required=True)))

    def zero(self) -> Any:
        """Declared default, else the zero of the type; None where absence is null."""
        if self.default is not None:
            return self.default
        if not self.is_single or self.is_message:
            return None
        if self.scalar in ("string", "bytes", "bool"):
            return {"string": "", "bytes": b"", "bool": False}[self.scalar]
        return 0.0 if self.scalar in ("float", "double") else 0


@dataclass(frozen=True)
class Message:
    """A named list of fields in declaration order."""

    name: str
    fields: tuple[Field, ...] = field(default_factory=tuple)

    def schema(self, names: list[str] | None = None) -> T.StructType:
        """The Spark struct of all or some fields."""
        return T.StructType([T.StructField(f.name, f.spark_type()) for f in self.chosen(names)])

    def chosen(self, names: list[str] | None = None) -> tuple[Field, ...]:
        """All fields, or those named."""
        if names is None:
            return self.fields
        unknown = set(names) - {f.name for f in self.fields}
        if unknown:
            raise ValueError(f"{self.name} has no field {sorted(unknown)}")
        return tuple(f for f in self.fields if f.name in names)


#: The envelope message.
SOURCE = Enum("source", (("NST_TEST", 0),))
SOURCED = Message(
    "sourced_packet",
    (
        Field(1, "source", SOURCE),
        Field(2, "source_id", "uint64"),
        Field(3, "source_name", "string"),
        Field(10, "packet", "bytes"),
    ),
)
