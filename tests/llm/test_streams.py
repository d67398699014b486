"""Transport streams that are not this module's own, and damaged ones."""

import random
import struct

from inkstone.llm import transport_stream as T


def payload(n):
    return random.Random(n).randbytes(n)


def cut(media, a, b):
    return media[: 188 * a] + media[188 * b :]


def test_gap_loses_one_unit():
    raw = payload(20480)
    media = T.mux(raw)
    s = T.demux(cut(media, 5, 6))
    assert (s.discontinuities, s.lost_units, s.payload) == (1, 1, raw[2048:]) and len(s.pts) == 9
    s = T.demux(media[:-188])
    assert s.lost_units == 1 and s.payload == raw[:-2048]


def test_packet_sent_twice_counts_once():
    raw = payload(9000)
    media = T.mux(raw)
    s = T.demux(media[: 188 * 6] + media[188 * 5 :])
    assert s.payload == raw and not s.discontinuities and not s.lost_units
    s = T.demux(media[: 188 * 6] + media[188 * 5 : 188 * 6] * 2 + media[188 * 6 :])
    assert s.discontinuities


def test_announced_jump_is_none():
    media = bytearray(T.mux(payload(2048 * 9)))
    at = next(k for k in range(10, len(media) // 188) if media[188 * k + 1] == 0x41 and media[188 * k + 3] & 0x20 and media[188 * k + 5] & 0x40)
    media[188 * at + 5] |= 0x80
    for k in range(at, len(media) // 188):
        if media[188 * k + 2] == 0 and media[188 * k + 1] & 31 == 1:
            media[188 * k + 3] = media[188 * k + 3] & 0xF0 | (media[188 * k + 3] + 5) & 15
    s = T.demux(bytes(media))
    assert not s.discontinuities and not s.lost_units


def test_lost_alignment_and_bad_packets():
    raw = payload(20480)
    media = T.mux(raw)
    s = T.demux(b"noise" + media[: 188 * 30] + b"\0" * 7 + media[188 * 30 :] + b"tail")
    assert s.payload == raw and s.sync_errors == 16
    bad = bytearray(media)
    bad[188 * 4 + 1] |= 0x80
    s = T.demux(bytes(bad))
    assert s.lost_units == 1 and s.sync_errors == 1 and s.payload == raw[2048:]
    assert T.demux(b"").packets == 0 and T.demux(b"no stream at all").payload == b""


def test_broken_checksum():
    media = bytearray(T.mux(payload(100)))
    media[20] ^= 1
    s = T.demux(bytes(media))
    assert s.crc_errors == 1 and not s.programs and s.payload == b""


def test_long_section_and_second_program():
    """A map table over three packets, two programs, one elementary stream each."""
    es = b"".join(struct.pack(">BHH", 6, 0xE000 | 0x200 + i, 0xF000) for i in range(80))
    body = struct.pack(">HH", 0xE000 | 0x200, 0xF000) + es
    pat = T._section(0, 1, struct.pack(">HHHH", 1, 0xE000 | 0x50, 2, 0xE000 | 0x51))
    one = T._section(2, 1, body)
    two = T._section(2, 2, struct.pack(">HHBHH", 0xE000 | 0x300, 0xF000, 0x1B, 0xE000 | 0x300, 0xF000))
    packets = [T._psi(0, pat).tobytes(), T._psi(0x51, two).tobytes()]
    raw = b"\0" + one
    for i in range(0, len(raw), 184):
        packets.append(struct.pack(">BHB", 0x47, (0x4000 if not i else 0) | 0x50, 0x10 | i // 184) + raw[i : i + 184].ljust(184, b"\xff"))
    pes = b"\0\0\1\xbd" + struct.pack(">H", 3 + 5) + b"\x80\0\0hello"
    for pid in (0x200, 0x300):
        packets.append(struct.pack(">BHBB", 0x47, 0x4000 | pid, 0x30, 183 - len(pes)) + b"\0" + b"\xff" * (182 - len(pes)) + pes)
    s = T.demux(b"".join(packets))
    assert len(packets[-1]) == 188 and len(s.programs[1]) == 80 and s.programs[2] == {0x300: 0x1B}
    assert s.payload == b"hellohello" and s.pts == [-1, -1] and not s.crc_errors
    s = T.demux(b"".join(packets[:3] + packets[4:]))
    assert 1 not in s.programs and s.discontinuities == 1


def test_store_of_nothing_and_repeats(spark):
    d = spark.createDataFrame([(1, "x"), (1, "x"), (None, None)], "doc_id long, text string")
    out = T.store(d).collect()
    assert len(out) == 3 and out[0] == out[1] and bytes(out[2].payload) == b"\0" * 64
    assert T.store(d.limit(0)).count() == 0
