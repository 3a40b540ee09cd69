"""Media columns: payloads in MPEG transport streams (ISO/IEC 13818-1).

``mux`` writes a programme of one private-data stream: programme tables,
packetised elementary stream (PES) packets with presentation times, and
random-access points.  ``demux`` parses streams of 188-byte packets: it reads the
programme association table with all its programmes, the map of each, sections
that reach over several packets, checks continuity counters (which may jump where
the stream says so) and table checksums, leaves packets out that are marked as damaged, reads the clock
references, reassembles the PES packets and lists times and random-access
points.  Scrambled payloads and adaptation extensions are not interpreted.

``store_documents`` makes a media column with an index (times, byte offsets and
random-access points of the units); ``media_digests`` writes it to the shared
folder, reads the stored bytes back and describes both.  ``seek`` reads from the
random-access point at or before a time.

Cases: a null payload counts as empty and is still padded to one unit, so
every stream holds one PES packet at least; the bytes depend on the payload
alone, so equal texts give equal media and ties need no rule; broken packets, failed table
checksums and counter gaps are counted and never raise; a very long text is
one value, held as a whole; only the key and the text are read, so further
columns of any name do no harm; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame

from .common import materialize, released

# Fixed values of the format.
PACKET = 188
SYNC = 0x47
PAT_PID = 0
PRIVATE_STREAM = 0xBD
PRIVATE_TYPE = 0x06
CLOCK = 90_000
# Our programme.
PROGRAM = 1
PMT_PID = 0x100
ES_PID = 0x101
UNIT = 16_384
TICKS = CLOCK // 25
RANDOM_ACCESS_EVERY = 8
#: Units from one clock reference to the next: 80 of the 100 ms that the format allows.
CLOCK_EVERY = 2
#: A unit is presented so long after the clock at its first packet.
DELAY = CLOCK // 10


def _table() -> list[int]:
    out = []
    for byte in range(256):
        c = byte << 24
        for _ in range(8):
            c = (c << 1 ^ 0x04C11DB7 if c & 0x80000000 else c << 1) & 0xFFFFFFFF
        out.append(c)
    return out


_CRC = _table()


def crc_mpeg(data: bytes) -> int:
    """The tables' checksum: CRC-32 with polynomial 04C11DB7, not reflected."""
    c = 0xFFFFFFFF
    for byte in data:
        c = (c << 8 & 0xFFFFFFFF) ^ _CRC[c >> 24 ^ byte]
    return c


def _section(table_id: int, key: int, body: bytes) -> bytes:
    length = 5 + len(body) + 4
    head = bytes([table_id, 0xB0 | length >> 8, length & 255, key >> 8, key & 255, 0xC1, 0, 0]) + body
    return head + crc_mpeg(head).to_bytes(4, "big")


_PAT = _section(0, 1, bytes([PROGRAM >> 8, PROGRAM & 255, 0xE0 | PMT_PID >> 8, PMT_PID & 255]))
_PMT = _section(2, PROGRAM, bytes([0xE0 | ES_PID >> 8, ES_PID & 255, 0xF0, 0, PRIVATE_TYPE, 0xE0 | ES_PID >> 8, ES_PID & 255, 0xF0, 0]))


def _pts(ticks: int) -> bytes:
    """A 33-bit time in its five-byte form, with the marker bits."""
    return bytes([0x21 | ticks >> 29 & 0x0E, ticks >> 22 & 255, ticks >> 14 & 0xFE | 1, ticks >> 7 & 255, ticks << 1 & 0xFE | 1])


def _read_pts(b: bytes) -> int:
    return (b[0] & 0x0E) << 29 | b[1] << 22 | (b[2] & 0xFE) << 14 | b[3] << 7 | b[4] >> 1


def _pcr(ticks: int) -> bytes:
    """A clock reference: 33 bits of 90 kHz, 6 reserved bits, and 9 bits of 27 MHz, here 0."""
    return (ticks << 15 | 0x3F << 9).to_bytes(6, "big")


def _read_pcr(b: bytes) -> int:
    """A clock reference in ticks of 27 MHz."""
    x = int.from_bytes(b[:6], "big")
    return (x >> 15) * 300 + (x & 0x1FF)


def _table_packet(pid: int, counter: int, section: bytes) -> bytes:
    head = bytes([SYNC, 0x40 | pid >> 8, pid & 255, 0x10 | counter & 15, 0])
    return head + section + b"\xff" * (PACKET - 5 - len(section))


#: (presentation time, byte offset of the packet that begins the unit, random access) of each unit.
Entry = tuple[int, int, bool]


def mux(payload: bytes, unit: int = UNIT) -> bytes:
    """The transport stream of ``payload``, one PES packet for each ``unit`` bytes."""
    return mux_indexed(payload, unit)[0]


def mux_indexed(payload: bytes, unit: int = UNIT) -> tuple[bytes, list[Entry]]:
    """The transport stream and its index; a random-access point begins with the programme tables."""
    out: list[bytes] = []
    index: list[Entry] = []
    counter = tables = 0
    heads = [bytes([SYNC, ES_PID >> 8, ES_PID & 255, 0x10 | c]) for c in range(16)]
    for k, at in enumerate(range(0, max(1, len(payload)), unit)):
        clock = k * TICKS & (1 << 33) - 1
        ticks = clock + DELAY & (1 << 33) - 1
        access = k % RANDOM_ACCESS_EVERY == 0
        index.append((ticks, len(out) * PACKET, access))
        if access:
            out += (_table_packet(PAT_PID, tables, _PAT), _table_packet(PMT_PID, tables, _PMT))
            tables += 1
        data = payload[at : at + unit]
        pes = b"\x00\x00\x01" + bytes([PRIVATE_STREAM]) + (len(data) + 8).to_bytes(2, "big") + b"\x84\x80\x05" + _pts(ticks) + data
        field_bytes = bytes([0x50 if access else 0x10]) + _pcr(clock) if access or k % CLOCK_EVERY == 0 else b""
        room = PACKET - 4 - (1 + len(field_bytes) if field_bytes else 0)
        done = 0
        start = True
        while done < len(pes):
            part = pes[done : done + room]
            if start or len(part) < PACKET - 4:
                spare = PACKET - 4 - len(part)
                if spare:  # length byte, flags, stuffing
                    inner = (field_bytes or b"\x00") if spare > 1 else b""
                    adaptation = bytes([spare - 1]) + inner + b"\xff" * (spare - 1 - len(inner))
                else:
                    adaptation = b""
                out.append(bytes([SYNC, (0x40 if start else 0) | ES_PID >> 8, ES_PID & 255, (0x30 if spare else 0x10) | counter]) + adaptation + part)
            else:
                out.append(heads[counter] + part)
            counter = counter + 1 & 15
            done += len(part)
            start, field_bytes, room = False, b"", PACKET - 4
    return b"".join(out), index


@dataclass
class Stream:
    """What ``demux`` finds: tables, PES payloads with times, and faults."""

    #: Programme of each map's packets, and type and programme of each elementary stream's.
    pmt_pids: dict[int, int] = field(default_factory=dict)
    es_pids: dict[int, int] = field(default_factory=dict)
    programs: dict[int, int] = field(default_factory=dict)
    packets: int = 0
    units: list[tuple[int, int, bool, bytes]] = field(default_factory=list)  # pid, pts (-1: none), random access, data
    counter_errors: int = 0
    table_errors: int = 0
    lost_bytes: int = 0
    #: Packets whose sender marked them as damaged.
    damaged: int = 0
    #: (packet id, clock in ticks of 27 MHz) of each clock reference.
    clocks: list[tuple[int, int]] = field(default_factory=list)

    @property
    def payload(self) -> bytes:
        return b"".join(u[3] for u in self.units)


def demux(data: bytes) -> Stream:
    """Parse a transport stream; bytes that form no packet are skipped to the next sync byte."""
    s = Stream()
    last: dict[int, int] = {}
    open_pes: dict[int, tuple[bool, list[bytes]]] = {}

    def close(pid: int) -> None:
        access, parts = open_pes.pop(pid, (False, []))
        raw = b"".join(parts)
        if raw[:3] != b"\x00\x00\x01" or len(raw) < 9:
            s.table_errors += bool(raw)
            return
        length, begin = int.from_bytes(raw[4:6], "big"), 9 + raw[8]
        ticks = _read_pts(raw[9:14]) if raw[7] & 0x80 and len(raw) >= 14 else -1
        s.units.append((pid, ticks, access, raw[begin : 6 + length] if length else raw[begin:]))

    sections: dict[int, bytearray] = {}

    def section(pid: int, raw: bytes) -> None:
        if len(raw) < 12 or crc_mpeg(raw) != 0:
            s.table_errors += 1
        elif pid == PAT_PID and raw[0] == 0:
            for k in range(8, len(raw) - 7, 4):
                program = raw[k] << 8 | raw[k + 1]
                if program:  # 0 names the network table
                    s.pmt_pids[(raw[k + 2] & 0x1F) << 8 | raw[k + 3]] = program
        elif pid in s.pmt_pids and raw[0] == 2:
            k = 12 + ((raw[10] & 15) << 8 | raw[11])
            while k + 5 <= len(raw) - 4:
                es = (raw[k + 1] & 0x1F) << 8 | raw[k + 2]
                s.es_pids[es], s.programs[es] = raw[k], s.pmt_pids[pid]
                k += 5 + ((raw[k + 3] & 15) << 8 | raw[k + 4])

    def feed(pid: int, body: bytes) -> None:
        """Adds table bytes; what follows the last whole section stays, stuffing goes."""
        held = sections.setdefault(pid, bytearray())
        held += body
        while len(held) >= 3 and held[0] != 0xFF:
            length = 3 + ((held[1] & 15) << 8 | held[2])
            if len(held) < length:
                return
            section(pid, bytes(held[:length]))
            del held[:length]
        if held[:1] == b"\xff":
            held.clear()

    def tables(pid: int, body: bytes, first: bool) -> None:
        if not first:
            if sections.get(pid):
                feed(pid, body)
            return
        if not body or 1 + body[0] > len(body):
            s.table_errors += 1
            return
        if sections.get(pid):
            feed(pid, body[1 : 1 + body[0]])
            if sections.get(pid):  # cut short by the next one
                s.table_errors += 1
                sections[pid].clear()
        feed(pid, body[1 + body[0] :])

    at = 0
    while at + PACKET <= len(data):
        if data[at] != SYNC:
            at += 1
            s.lost_bytes += 1
            continue
        b1, pid, b3 = data[at + 1], (data[at + 1] & 0x1F) << 8 | data[at + 2], data[at + 3]
        begin, end, access = at + 4, at + PACKET, False
        at = end
        s.packets += 1
        if b1 & 0x80:
            s.damaged += 1
            continue
        if b3 & 0x20:
            size = data[begin]
            flags = data[begin + 1] if size else 0
            access = bool(flags & 0x40)
            if flags & 0x80:  # the counter may start anew here
                last.pop(pid, None)
            if flags & 0x10 and size >= 7 and begin + 8 <= end:
                s.clocks.append((pid, _read_pcr(data[begin + 2 : begin + 8])))
            begin += 1 + size
        if not b3 & 0x10 or begin >= end:
            continue
        counter = b3 & 15
        if pid in last and counter != last[pid] + 1 & 15:
            if counter == last[pid]:
                continue  # a repeated packet
            s.counter_errors += 1
        last[pid] = counter
        body = data[begin:end]
        if pid == PAT_PID or pid in s.pmt_pids:
            tables(pid, body, bool(b1 & 0x40))
        elif pid in s.es_pids:
            if b1 & 0x40:
                close(pid)
                open_pes[pid] = (access, [body])
            elif pid in open_pes:
                open_pes[pid][1].append(body)
    s.lost_bytes += len(data) - at
    s.table_errors += sum(bool(x) for x in sections.values())
    for pid in list(open_pes):
        close(pid)
    return s


def pad(raw: bytes, multiple: int = 64) -> bytes:
    """Zero bytes up to a positive multiple."""
    return raw + bytes(max(multiple, -(-len(raw) // multiple) * multiple) - len(raw))


INDEX = "array<struct<pts: long, offset: long, random_access: boolean>>"
_INDEX = pa.list_(pa.struct([("pts", pa.int64()), ("offset", pa.int64()), ("random_access", pa.bool_())]))


def store_documents(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, n_bytes, media, units): every text as a transport stream, with the index of its units."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, media, index = [], [], []
            for text in batch.column(1):
                raw = (text.as_py() or "").encode("utf-8")
                stream, units = mux_indexed(pad(raw))
                sizes.append(len(raw))
                media.append(stream)
                index.append([dict(zip(("pts", "offset", "random_access"), u, strict=True)) for u in units])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64()), pa.array(media, pa.binary()), pa.array(index, _INDEX)], [key, "n_bytes", "media", "units"])

    kind = df.schema[key].dataType.simpleString()
    return df.select(key, text).mapInArrow(released(run), f"`{key}` {kind}, n_bytes long, media binary, units {INDEX}")


def seek(media: bytes, units: list[Entry], pts: int) -> Stream:
    """The stream from the last random-access point at or before a time on, or from the first."""
    points = [at for t, at, access in units if access and t <= pts]
    return demux(media[points[-1] if points else 0 :])


def parse_media(df: DataFrame, key: str = "doc_id", media: str = "media") -> DataFrame:
    """(key, unit, pid, pts, random_access, data): the elementary packets of every stream."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                units = demux(batch.column(1)[k].as_py() or b"").units
                cols = list(zip(*units, strict=True)) if units else [(), (), (), ()]
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).take(pa.array([k] * len(units), pa.int32())),
                        pa.array(range(len(units)), pa.int64()),
                        pa.array(cols[0], pa.int32()),
                        pa.array([None if t < 0 else t for t in cols[1]], pa.int64()),
                        pa.array(cols[2], pa.bool_()),
                        pa.array(cols[3], pa.binary()),
                    ],
                    [key, "unit", "pid", "pts", "random_access", "data"],
                )

    kind = df.schema[key].dataType.simpleString()
    return df.select(key, media).mapInArrow(released(run), f"`{key}` {kind}, unit long, pid int, pts long, random_access boolean, data binary")


def feature_text(s: Stream, units: list[Entry]) -> str:
    """One line about a stream: tables, packets, faults, times and access points, and whether the index says the same."""
    times = [u[1] for u in s.units if u[1] >= 0]
    points = [str(u[1]) for u in s.units if u[2]]
    types = ",".join(f"{s.programs[p]}/{p}:{t}" for p, t in sorted(s.es_pids.items()))
    same = [(t, a) for _, t, a, _ in s.units] == [(t, a) for t, _, a in units]
    return (
        f"maps={','.join(map(str, sorted(s.pmt_pids)))};streams={types};packets={s.packets};units={len(s.units)};counter_errors={s.counter_errors};"
        f"table_errors={s.table_errors};lost={s.lost_bytes};first_pts={times[0] if times else ''};last_pts={times[-1] if times else ''};"
        f"clocks={len(s.clocks)}:{max((b - a for (_, a), (_, b) in zip(s.clocks, s.clocks[1:], strict=False)), default=0) // 300};damaged={s.damaged};random_access={len(points)}:{zlib.crc32(','.join(points).encode())};indexed={str(same).lower()}"
    )


def describe_media(df: DataFrame, key: str = "doc_id") -> DataFrame:
    """Digests of stored media (key, n_bytes, media, units) and of the payloads read from them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [key, "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]
        for batch in batches:
            rows = []
            for media, index in zip(batch.column(2), batch.column(3), strict=True):
                media = media.as_py()
                stream = demux(media)
                back = stream.payload
                units = [(u["pts"], u["offset"], u["random_access"]) for u in index.as_py()]
                rows.append((len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-64:]), len(media), hashlib.sha256(media).hexdigest(), feature_text(stream, units)))
            cols = list(zip(*rows, strict=True)) if rows else [()] * 6
            kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *map(pa.array, cols, kinds)], names)

    kind = df.schema[key].dataType.simpleString()
    return df.select(key, "n_bytes", "media", "units").mapInArrow(
        released(run),
        f"`{key}` {kind}, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string",
    )


def media_digests(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Store every text in the shared folder, read the stored bytes back and describe both."""
    return describe_media(materialize(store_documents(df, key, text), "media", compression="zstd"), key)
