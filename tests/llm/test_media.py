"""Transport streams: round trips, faults, tables over several packets, stored media with their index."""

import hashlib
import random
import zlib

from palimpsest.llm import mpegts as M
from palimpsest.llm.common import materialize, read
from palimpsest.llm.queries import op8_mpegts

SF = "/root/testdata/sf0.001"


def test_round_trip_and_faults():
    pick = random.Random(4)
    for size in (0, 1, 64, 150, 184, 16_384, 16_385, 300_001):
        raw = M.pad(pick.randbytes(size))
        media, units = M.mux_indexed(raw)
        stream = M.demux(media)
        assert stream.payload == raw and len(media) % 188 == 0
        assert (stream.counter_errors, stream.table_errors, stream.lost_bytes) == (0, 0, 0)
        assert [(u[1], u[2]) for u in stream.units] == [(t, a) for t, _, a in units] and all(media[at] == M.SYNC for _, at, _ in units)
    broken = media[: 188 * 10] + media[188 * 11 :]
    assert M.demux(broken).counter_errors == 1
    assert M.demux(b"junk" + media).payload == raw
    assert M.demux(media[:188] + media[:188] + media[188:]).payload == raw  # a repeated packet


def test_seeking_starts_at_a_random_access_point():
    raw = random.Random(5).randbytes(20 * M.UNIT)
    media, units = M.mux_indexed(raw)
    for pts in (0, M.TICKS * 7, M.TICKS * 8, M.TICKS * 17):
        first = pts // M.TICKS // M.RANDOM_ACCESS_EVERY * M.RANDOM_ACCESS_EVERY
        stream = M.seek(media, units, pts + M.DELAY)
        assert stream.payload == raw[first * M.UNIT :] and stream.units[0][1] == first * M.TICKS + M.DELAY and stream.units[0][2]


def test_clock_references_and_marked_packets():
    """A clock at every access point and within 100 ms, ahead of what it times; jumps that are announced are no fault, damaged packets are left out."""
    raw = random.Random(6).randbytes(21 * M.UNIT - 7)
    media, units = M.mux_indexed(raw)
    stream = M.demux(media)
    assert stream.payload == raw and {p for p, _ in stream.clocks} == {M.ES_PID}
    clocks = [c for _, c in stream.clocks]
    assert clocks[0] == 0 and all(0 < b - a <= 27_000_000 // 10 for a, b in zip(clocks, clocks[1:]))  # noqa: B905
    assert {(t - M.DELAY) * 300 for t, _, access in units if access} <= set(clocks)
    assert M._read_pcr(M._pcr((1 << 33) - 1)) == ((1 << 33) - 1) * 300

    # Two recordings one after the other: the counter of the second starts anew.
    joined = M.demux(media + media)
    assert joined.counter_errors == 3  # both tables and the stream
    marked = bytearray(media + media)
    for at in range(len(media), 2 * len(media), 188):
        if marked[at + 3] & 0x20 and marked[at + 4]:
            marked[at + 5] |= 0x80
            break
    assert M.demux(bytes(marked)).counter_errors == 2
    hurt = bytearray(media)
    hurt[188 * 40 + 1] |= 0x80
    found = M.demux(bytes(hurt))
    assert (found.damaged, found.counter_errors) == (1, 1) and len(found.payload) == len(raw) - 184


def packets(pid, body):
    """A section, or several, over as many packets as it takes."""
    out, data, first = [], b"\0" + body, True
    while data:
        part, data = data[:184], data[184:]
        out.append(bytes([M.SYNC, (0x40 if first else 0) | pid >> 8, pid & 255, 0x10 | len(out) & 15]) + part + b"\xff" * (184 - len(part)))
        first = False
    return b"".join(out)


def test_many_programmes_and_long_sections():
    programs = [(0, 0x10)] + [(k, 0x200 + k) for k in range(1, 90)]
    pat = M._section(0, 1, b"".join(bytes([n >> 8, n & 255, 0xE0 | p >> 8, p & 255]) for n, p in programs))
    assert len(pat) > 184
    pmt = M._section(2, 7, bytes([0xE3, 0, 0xF0, 0]) + b"".join(bytes([6, 0xE3, k, 0xF0, 60]) + bytes(60) for k in range(6)))
    s = M.demux(packets(0, pat) + packets(0x207, pmt))
    assert s.pmt_pids == {p: n for n, p in programs[1:]} and s.es_pids == {0x300 + k: 6 for k in range(6)} and set(s.programs.values()) == {7} and not s.table_errors
    two = M.demux(packets(0, M._PAT + M._PAT))
    assert two.pmt_pids == {M.PMT_PID: M.PROGRAM} and not two.table_errors
    spoiled = bytearray(packets(0, pat))
    spoiled[100] ^= 1
    assert M.demux(bytes(spoiled)).table_errors == 1


def test_every_row_of_the_query(spark):
    texts = {r.doc_id: r.text or "" for r in read(spark, SF, "documents").collect()}
    rows = op8_mpegts(spark, SF).collect()
    assert len(rows) == len(texts)
    for r in rows:
        raw = texts[r.doc_id].encode()
        payload = raw + bytes(max(64, -(-len(raw) // 64) * 64) - len(raw))
        media = M.mux(payload)
        assert (r.n_bytes, r.payload_bytes, r.media_bytes) == (len(raw), len(payload), len(media)) and r.tail_crc32 == zlib.crc32(payload[-64:])
        assert r.payload_sha256 == hashlib.sha256(payload).hexdigest() and r.media_sha256 == hashlib.sha256(media).hexdigest()
        assert f"units={-(-len(payload) // M.UNIT)};counter_errors=0;table_errors=0;lost=0;" in r.feature and r.feature.endswith("indexed=true")


def test_cases(spark):
    rows = [(None, None, "m"), (1, "", "m"), (2, "é" * 40_000, "m"), (2, "é" * 40_000, "m")]
    df = spark.createDataFrame(rows, "doc_id long, text string, media string")
    out = M.media_digests(df).collect()
    assert len(out) == 4 and len({r.media_sha256 for r in out if r.doc_id == 2}) == 1 and {r.payload_bytes for r in out if r.doc_id != 2} == {64}
    assert M.media_digests(df.limit(0)).count() == 0
    units = M.parse_media(materialize(M.store_documents(df.where("doc_id = 2").limit(1)), "test-media"))
    assert b"".join(r.data for r in units.orderBy("unit").collect()).decode().rstrip("\0") == "é" * 40_000
    assert units.where("random_access").count() == 1 and units.agg({"pts": "max"}).first()[0] == 4 * M.TICKS + M.DELAY
