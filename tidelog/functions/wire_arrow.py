"""Reading wire payloads in Arrow batches.

Spark hands over a binary column; all payloads of a batch advance together, one field
per step, with numpy on the shared byte buffer.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa

from tidelog.functions.messages import (
    BYTES,
    END_GROUP,
    FIXED32,
    FIXED64,
    GROUP,
    SCALARS,
    VARINT,
    Field,
    Message,
)

PAD = 16

#: What a broken payload reports.
TRUNCATED, BAD_TAG, BAD_WIRE = "truncated value", "invalid tag", "invalid wire type"


class Batch:
    """The bytes of a batch, its payload bounds, and the first error of each row."""

    def __init__(self, column: pa.Array):
        column = column.cast(pa.large_binary())
        _, offsets, data = column.buffers()
        bounds = np.frombuffer(offsets, np.int64, len(column) + 1, column.offset * 8)
        size = int(bounds[-1]) if len(column) else 0
        self.bytes = np.zeros(size + PAD, np.uint8)
        if size:
            self.bytes[:size] = np.frombuffer(data, np.uint8, size)
        self.starts, self.ends = bounds[:-1], bounds[1:]
        self.valid = np.asarray(column.is_valid())
        self.errors = np.full(len(column), None, object)

    def fail(self, rows: np.ndarray, reason: str) -> None:
        fresh = rows[np.equal(self.errors[rows], None)]
        self.errors[fresh] = reason

    def varint(self, pos: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Values and sizes of the varints at ``pos``; size 0 where one does not end
        before ``end`` or exceeds 64 bits."""
        value = np.zeros(len(pos), np.uint64)
        size = np.zeros(len(pos), np.int64)
        open_ = np.arange(len(pos))
        for i in range(10):
            at = pos[open_] + i
            inside = at < end[open_]
            open_, at = open_[inside], at[inside]
            if not len(open_):
                break
            byte = self.bytes[at].astype(np.uint64)
            if i == 9:
                keep = byte < 2
                open_, byte = open_[keep], byte[keep]
            value[open_] |= (byte & np.uint64(127)) << np.uint64(7 * i)
            done = byte < 128
            size[open_[done]] = i + 1
            open_ = open_[~done]
        return value, size

    def fixed(self, pos: np.ndarray, width: int) -> np.ndarray:
        """Little-endian numbers at ``pos`` as uint64."""
        grid = self.bytes[pos[:, None] + np.arange(width)]
        return np.ascontiguousarray(grid).view(f"<u{width}").ravel().astype(np.uint64)

    def slices(self, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The bytes of all slices one after another, and their offsets."""
        lengths = end - start
        offsets = np.concatenate([[0], np.cumsum(lengths)])
        index = np.repeat(start - offsets[:-1], lengths) + np.arange(offsets[-1])
        return self.bytes[index], offsets


class Step:
    """One field occurrence of each row in ``rows``."""

    __slots__ = ("rows", "number", "wire", "bits", "start", "end", "tag_at")

    def __init__(self, rows, number, wire, bits, start, end, tag_at):
        self.rows, self.number, self.wire = rows, number, wire
        self.bits, self.start, self.end, self.tag_at = bits, start, end, tag_at

    def take(self, mask: np.ndarray) -> "Step":
        return Step(*[getattr(self, name)[mask] for name in self.__slots__])


def _skip_group(batch: Batch, pos: int, end: int) -> int:
    """Position after a group's end tag, or -1."""
    depth = 1
    while depth:
        at, bound = np.array([pos]), np.array([end])
        tag, size = batch.varint(at, bound)
        if not size[0]:
            return -1
        pos, wire = pos + int(size[0]), int(tag[0]) & 7
        if wire == GROUP:
            depth += 1
        elif wire == END_GROUP:
            depth -= 1
        elif wire in (VARINT, BYTES):
            value, size = batch.varint(np.array([pos]), bound)
            if not size[0]:
                return -1
            pos += int(size[0]) + (int(value[0]) if wire == BYTES else 0)
        elif wire in (FIXED32, FIXED64):
            pos += 4 if wire == FIXED32 else 8
        else:
            return -1
        if pos > end:
            return -1
    return pos


def walk(batch: Batch, starts: np.ndarray, ends: np.ndarray, owner: np.ndarray) -> Iterator[Step]:
    """Step through the slices; ``owner`` maps a slice to the batch row that gets its
    errors. A slice stops at its first error."""
    pos, ends = starts.copy(), np.asarray(ends)
    live = np.flatnonzero(pos < ends)
    while len(live):
        at, end = pos[live], ends[live]
        tag, size = batch.varint(at, end)
        number, wire = (tag >> np.uint64(3)).astype(np.int64), (tag & np.uint64(7)).astype(np.int64)
        bad_tag = (size == 0) | (number > 0x7FFFFFFF)
        start = at + size
        bits = np.zeros(len(live), np.uint64)
        stop = start.copy()
        broken = bad_tag.copy()
        for kind in np.unique(wire[~bad_tag]):
            m = np.flatnonzero((wire == kind) & ~bad_tag)
            if kind == VARINT:
                bits[m], taken = batch.varint(start[m], end[m])
                stop[m] = start[m] + taken
                broken[m] = taken == 0
            elif kind in (FIXED32, FIXED64):
                width = 4 if kind == FIXED32 else 8
                stop[m] = start[m] + width
                broken[m] = stop[m] > end[m]
                whole = m[~broken[m]]
                bits[whole] = batch.fixed(start[whole], width)
            elif kind == BYTES:
                length, taken = batch.varint(start[m], end[m])
                start[m] += taken
                room = (end[m] - start[m]).astype(np.uint64)
                broken[m] = (taken == 0) | (length > room)
                stop[m] = start[m] + np.where(broken[m], 0, length).astype(np.int64)
            elif kind == GROUP:
                after = np.array([_skip_group(batch, int(s), int(e)) for s, e in zip(start[m], end[m])])
                broken[m] = after < 0
                stop[m] = after
            else:
                broken[m] = True
        if broken.any():
            odd = ~np.isin(wire, (VARINT, FIXED32, FIXED64, BYTES, GROUP))
            for mask, reason in ((bad_tag, BAD_TAG), (odd, BAD_WIRE), (broken, TRUNCATED)):
                batch.fail(owner[live[broken & mask]], reason)
        ok = ~broken
        if ok.any():
            yield Step(live[ok], number[ok], wire[ok], bits[ok], start[ok], stop[ok], at[ok])
        pos[live[ok]] = stop[ok]
        live = live[ok]
        live = live[pos[live] < ends[live]]


def _gather(steps: list[Step]) -> Step:
    return Step(*[np.concatenate([getattr(s, name) for s in steps]) for name in Step.__slots__])


def _numbers(kind: str, bits: np.ndarray) -> pa.Array:
    """Raw 64-bit patterns as values of a scalar kind."""
    if kind in ("sint32", "sint64"):
        one = np.uint64(1)
        bits = (bits >> one) ^ (np.uint64(0) - (bits & one))
    if kind == "bool":
        return pa.array(bits != 0)
    if kind in ("int32", "sint32", "sfixed32"):
        return pa.array(bits.astype(np.uint32).view(np.int32))
    if kind in ("uint32", "fixed32"):
        return pa.array(bits.astype(np.uint32).astype(np.int64))
    if kind in ("uint64", "fixed64"):
        return pa.array(bits).cast(pa.decimal128(20, 0))
    if kind == "float":
        return pa.array(bits.astype(np.uint32).view(np.float32))
    if kind == "double":
        return pa.array(bits.view(np.float64))
    return pa.array(bits.view(np.int64))


def _texts(batch: Batch, kind: str, start: np.ndarray, end: np.ndarray) -> pa.Array:
    """Byte slices as strings or binaries; text is not validated."""
    data, offsets = batch.slices(start, end)
    parts = [None, pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(data)]
    return pa.Array.from_buffers(pa.string() if kind == "string" else pa.binary(), len(start), parts)


def _values(batch: Batch, field: Field, found: Step, owner: np.ndarray) -> pa.Array:
    """One value per occurrence; an empty submessage is null."""
    if field.is_message:
        return read_message(batch, field.kind.fields, found.start, found.end, owner[found.rows], found.end > found.start)
    if field.wire == BYTES:
        return _texts(batch, field.scalar, found.start, found.end)
    return _numbers(field.scalar, found.bits)


def _unpack(batch: Batch, field: Field, blocks: Step, owner: np.ndarray) -> Step:
    """The elements of packed blocks as single occurrences, in order."""
    data, offsets = batch.slices(blocks.start, blocks.end)
    block = np.repeat(np.arange(len(blocks.rows)), np.diff(offsets))
    if field.wire == VARINT:
        last = np.flatnonzero(data < 128)
        cut = np.flatnonzero((np.diff(offsets) > 0) & (data[np.maximum(offsets[1:], 1) - 1] >= 128)) if len(data) else []
        batch.fail(owner[blocks.rows[cut]], TRUNCATED)
        first = np.concatenate([[0], last[:-1] + 1]) if len(last) else last
        first = np.maximum(first, offsets[block[last]])
        base = blocks.start[block[last]] - offsets[block[last]]
        start, end = base + first, base + last + 1
        bits, size = batch.varint(start, end)
        batch.fail(owner[blocks.rows[block[last[size == 0]]]], TRUNCATED)
        which = block[last]
    else:
        width = 4 if field.wire == FIXED32 else 8
        counts = np.diff(offsets) // width
        batch.fail(owner[blocks.rows[np.diff(offsets) % width != 0]], TRUNCATED)
        which = np.repeat(np.arange(len(blocks.rows)), counts)
        place = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)
        start = blocks.start[which] + place * width
        end, bits = start + width, batch.fixed(start, width)
    return Step(blocks.rows[which], blocks.number[which], np.full(len(which), field.wire), bits, start, end, blocks.tag_at[which])


def _in_rows(found: Step, rows: int) -> tuple[Step, pa.Array]:
    """Occurrences grouped by row in payload order, and list offsets."""
    found = found.take(np.lexsort((found.start, found.rows)))
    counts = np.bincount(found.rows, minlength=rows)
    return found, pa.array(np.concatenate([[0], np.cumsum(counts)]).astype(np.int32))


def _list_offsets(offsets: pa.Array) -> pa.Array:
    """Offsets with rows that hold nothing marked null."""
    counts = np.diff(offsets.to_numpy())
    return pa.array(offsets.to_numpy(), mask=np.concatenate([counts == 0, [False]]))


def _map_array(batch: Batch, field: Field, found: Step, rows: int, owner: np.ndarray) -> pa.Array:
    """Entries of a map field; the last entry of a key wins, a missing key or value is
    the zero of its type."""
    found, _ = _in_rows(found, rows)
    entry = field.entry()
    entries = read_message(batch, entry.fields, found.start, found.end, owner[found.rows], None)
    key, value = entries.field(0), entries.field(1)
    key = key.fill_null(pa.scalar(entry.fields[0].zero(), key.type))
    if not field.is_message:
        value = value.fill_null(pa.scalar(entry.fields[1].zero(), value.type))
    table = pd.DataFrame({"row": found.rows, "key": key.to_pandas()})
    keep = np.flatnonzero(~table.duplicated(keep="last").to_numpy())
    counts = np.bincount(found.rows[keep], minlength=rows)
    offsets = pa.array(np.concatenate([[0], np.cumsum(counts)]).astype(np.int32))
    return pa.MapArray.from_arrays(_list_offsets(offsets), key.take(pa.array(keep)), value.take(pa.array(keep)))


def _column(batch: Batch, field: Field, steps: list[Step], rows: int, owner: np.ndarray) -> pa.Array:
    if not steps:
        return pa.nulls(rows, arrow_type(field))
    found = _gather(steps)
    if field.map_key is not None:
        return _map_array(batch, field, found.take(found.wire == BYTES), rows, owner)
    if field.repeated and field.wire != BYTES:
        blocks = found.take(found.wire == BYTES)
        if len(blocks.rows):
            found = _gather([found.take(found.wire != BYTES), _unpack(batch, field, blocks, owner)])
    found = found.take(found.wire == field.wire)
    if field.repeated:
        found, offsets = _in_rows(found, rows)
        return pa.ListArray.from_arrays(_list_offsets(offsets), _values(batch, field, found, owner))
    last = np.full(rows, -1, np.int64)
    last[found.rows] = np.arange(len(found.rows))
    used = last[last >= 0]
    slot = np.full(rows, -1, np.int64)
    slot[last >= 0] = np.arange(len(used))
    values = _values(batch, field, found.take(used), owner)
    return values.take(pa.array(slot, mask=slot < 0))


def read_message(batch, fields, starts, ends, owner, present) -> pa.StructArray:
    """Slices as structs of ``fields``; fields not asked for are skipped unread."""
    found: dict[int, list[Step]] = {f.number: [] for f in fields}
    for step in walk(batch, starts, ends, owner):
        for number in np.unique(step.number):
            if int(number) in found:
                found[int(number)].append(step.take(step.number == number))
    columns = [_column(batch, f, found[f.number], len(starts), owner) for f in fields]
    mask = None if present is None else pa.array(~np.asarray(present, bool))
    kinds = [pa.field(f.name, arrow_type(f)) for f in fields]
    return pa.StructArray.from_arrays(columns, fields=kinds, mask=mask)


def arrow_type(field: Field) -> pa.DataType:
    """Arrow type of a field."""
    if field.map_key is not None:
        return pa.map_(_scalar_arrow(field.map_key), _value_arrow(field))
    return pa.list_(_value_arrow(field)) if field.repeated else _value_arrow(field)


def _value_arrow(field: Field) -> pa.DataType:
    if field.is_message:
        return pa.struct([pa.field(f.name, arrow_type(f)) for f in field.kind.fields])
    return _scalar_arrow(field.scalar)


def _scalar_arrow(kind: str) -> pa.DataType:
    from pyspark.sql.pandas.types import to_arrow_type

    return to_arrow_type(SCALARS[kind][1])


def decode_batch(column: pa.Array, message: Message, names: list[str] | None) -> tuple[pa.StructArray, pa.Array]:
    """Structs and error texts of a payload column; a broken payload is null."""
    batch = Batch(column)
    owner = np.arange(len(column))
    fields = message.chosen(names)
    structs = read_message(batch, fields, batch.starts, batch.ends, owner, None)
    good = batch.valid & np.equal(batch.errors, None).astype(bool)
    kinds = [pa.field(f.name, arrow_type(f)) for f in fields]
    masked = pa.StructArray.from_arrays(structs.flatten(), fields=kinds, mask=pa.array(~good))
    return masked, pa.array(batch.errors, pa.string())


#: Columns of one field occurrence.
OCCURRENCE = pa.struct(
    [
        pa.field("field_no", pa.int64()),
        pa.field("wire_type", pa.int32()),
        pa.field("nth", pa.int32()),
        pa.field("pos", pa.int32()),
        pa.field("len", pa.int32()),
        pa.field("raw", pa.binary()),
    ]
)


def scan_batch(column: pa.Array) -> tuple[pa.Array, pa.Array]:
    """Per payload the list of its field occurrences and its error text; a broken payload
    has no list."""
    batch = Batch(column)
    rows = len(column)
    steps = list(walk(batch, batch.starts, batch.ends, np.arange(rows)))
    bad = ~batch.valid | ~np.equal(batch.errors, None).astype(bool)
    errors = pa.array(batch.errors, pa.string())
    if not steps:
        nothing = pa.array(np.zeros(rows + 1, np.int32), mask=np.concatenate([bad, [False]]))
        return pa.ListArray.from_arrays(nothing, pa.nulls(0, OCCURRENCE)), errors
    found = _gather(steps)
    found = found.take(~bad[found.rows])
    found, offsets = _in_rows(found, rows)
    nth = pd.DataFrame({"r": found.rows, "n": found.number, "w": found.wire}).groupby(["r", "n", "w"]).cumcount()
    items = pa.StructArray.from_arrays(
        [
            pa.array(found.number, pa.int64()),
            pa.array(found.wire, pa.int32()),
            pa.array(nth.to_numpy() + 1, pa.int32()),
            pa.array(found.tag_at - batch.starts[found.rows], pa.int32()),
            pa.array(found.end - found.start, pa.int32()),
            _texts(batch, "bytes", found.start, found.end),
        ],
        fields=list(OCCURRENCE),
    )
    marks = pa.array(offsets.to_numpy(), mask=np.concatenate([bad, [False]]))
    return pa.ListArray.from_arrays(marks, items), errors
