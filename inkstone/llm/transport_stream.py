"""Media columns as MPEG transport streams (operator 5).

``mux`` stores a payload losslessly in a transport stream: program association
and map tables before each random-access point, one elementary stream of
private data whose access units travel in PES packets with time stamps, clock
references and stuffing.  ``demux`` reads a stream back, its own or another: it
parses the program tables (sections of any length over several packets, with
their checksums), checks continuity counters per PID, reassembles elementary
packets, and returns time stamps with random-access points.  ``store(df)`` adds
the stream and what was read from it as columns.

Damaged streams raise nothing.  Bytes outside packets and packets marked as bad
are counted and passed over; a packet sent twice counts once; a jump of the
counter that the stream announces is none.  An elementary packet with a gap, a
wrong start or too few bytes is a lost unit: it is counted, and its bytes are not
in the payload.

Defined results.  Null or empty text: a payload of 64 zero bytes.  Equal texts
give equal bytes and values.  Extra input columns are dropped.  Work and memory
are per document.
"""

from __future__ import annotations

import struct
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from inkstone.llm.common import map_batches, ragged, table, texts_of

PACKET, SYNC, UNIT = 188, 0x47, 64
PAT_PID, PMT_PID, DATA_PID, PRIVATE_DATA = 0, 0x1000, 0x100, 0x06
#: Bytes of payload in one access unit; access units from one random-access point to the next; clock ticks between units.
AU, GROUP, TICKS = 2048, 8, 3600


@lru_cache(maxsize=1)
def _crc_table() -> np.ndarray:
    t = np.arange(256, dtype=np.uint64) << np.uint64(24)
    for _ in range(8):
        t = np.where(t & np.uint64(1 << 31), (t << np.uint64(1)) ^ np.uint64(0x04C11DB7), t << np.uint64(1)) & np.uint64(0xFFFFFFFF)
    return t


@lru_cache(maxsize=1024)
def crc_mpeg(data: bytes) -> int:
    """The tables' CRC-32: polynomial 0x04C11DB7, most significant bit first, start all ones."""
    t, c = _crc_table(), 0xFFFFFFFF
    for b in data:
        c = ((c << 8) & 0xFFFFFFFF) ^ int(t[(c >> 24) ^ b])
    return c


def _section(table_id: int, ext: int, body: bytes) -> bytes:
    head = struct.pack(">BHHBBB", table_id, 0xB000 | (len(body) + 9), ext, 0xC1, 0, 0) + body
    return head + struct.pack(">I", crc_mpeg(head))


def _psi(pid: int, section: bytes) -> np.ndarray:
    raw = struct.pack(">BHB", SYNC, 0x4000 | pid, 0x10) + b"\0" + section
    return np.frombuffer(raw.ljust(PACKET, b"\xff"), np.uint8)


@lru_cache(maxsize=1)
def _tables() -> np.ndarray:
    pat = _section(0, 1, struct.pack(">HH", 1, 0xE000 | PMT_PID))
    pmt = _section(2, 1, struct.pack(">HHBHH", 0xE000 | DATA_PID, 0xF000, PRIVATE_DATA, 0xE000 | DATA_PID, 0xF000))
    return np.stack([_psi(PAT_PID, pat), _psi(PMT_PID, pmt)])


@lru_cache(maxsize=256)
def _layout(size: int, rap: bool) -> tuple[np.ndarray, np.ndarray]:
    """Packets of one access unit of ``size`` bytes, zero where PES bytes go, and the places of those bytes."""
    left, packets, places = size + 14, [], []
    while left:
        lead = 8 if rap and not packets else 0
        room = PACKET - 4 - lead
        take = min(left, room)
        stuff = room - take
        extra = lead + stuff  # bytes of adaptation field with its length byte
        p = np.zeros(PACKET, np.uint8)
        p[:4] = SYNC, (0x40 if not packets else 0) | DATA_PID >> 8, DATA_PID & 255, 0x30 if extra else 0x10
        if extra:
            p[4] = extra - 1
            if extra > 1:
                p[5] = 0x50 if lead else 0
                p[6 + 6 * bool(lead) : 4 + extra] = 0xFF
        places.append(PACKET * len(packets) + 4 + extra + np.arange(take))
        packets.append(p)
        left -= take
    return np.concatenate(packets), np.concatenate(places)


def _stamp(pts: int) -> bytes:
    return bytes([0x21 | (pts >> 29) & 0x0E, pts >> 22 & 255, 1 | pts >> 14 & 0xFE, pts >> 7 & 255, 1 | pts << 1 & 0xFE])


def mux(payload: bytes) -> bytes:
    out: list[np.ndarray] = []
    cc = tables = 0
    for i, at in enumerate(range(0, len(payload), AU)):
        data, rap, pts = payload[at : at + AU], i % GROUP == 0, (TICKS * i) % (1 << 33)
        if rap:
            psi = _tables().copy()
            psi[:, 3] |= tables & 15
            tables += 1
            out.append(psi.ravel())
        pes = b"\x00\x00\x01\xbd" + struct.pack(">H", len(data) + 8) + b"\x84\x80\x05" + _stamp(pts) + data
        blank, places = _layout(len(data), rap)
        p = blank.copy()
        p[places] = np.frombuffer(pes, np.uint8)
        n = len(p) // PACKET
        p[3::PACKET] |= ((cc + np.arange(n)) & 15).astype(np.uint8)
        cc += n
        if rap:
            p[6:12] = np.frombuffer(struct.pack(">IH", pts >> 1, (pts & 1) << 15 | 0x7E00), np.uint8)
        out.append(p)
    return np.concatenate(out).tobytes() if out else b""


@dataclass
class Stream:
    """What a transport stream holds."""

    programs: dict[int, dict[int, int]] = field(default_factory=dict)  # program -> PID -> stream type
    packets: int = 0
    discontinuities: int = 0
    crc_errors: int = 0
    sync_errors: int = 0  # bytes outside packets, and packets marked as bad
    lost_units: int = 0
    payload: bytes = b""
    pts: list[int] = field(default_factory=list)
    random_access: list[bool] = field(default_factory=list)
    packet_index: list[int] = field(default_factory=list)  # where each access unit begins

    def feature(self) -> str:
        es = ",".join(f"{pid:x}:{kind:x}" for p in sorted(self.programs) for pid, kind in sorted(self.programs[p].items()))
        span = f"{self.pts[0]}-{self.pts[-1]}" if self.pts else "none"
        return f"programs={len(self.programs)};es={es};packets={self.packets};units={len(self.pts)};rap={sum(self.random_access)};pts={span};cc_errors={self.discontinuities};crc_errors={self.crc_errors}"


def _aligned(media: bytes, out: Stream) -> np.ndarray:
    """The packets, without bytes between them and packets marked as bad."""
    raw = np.frombuffer(media, np.uint8)
    whole = raw[: len(raw) // PACKET * PACKET].reshape(-1, PACKET)
    if len(raw) % PACKET or (whole[:, 0] != SYNC).any():
        found, at, n = [], 0, len(raw)
        while at + PACKET <= n:
            if raw[at] == SYNC and (at + PACKET >= n or raw[at + PACKET] == SYNC or (found and found[-1] == at - PACKET)):
                found.append(at)
                at += PACKET
            else:
                out.sync_errors += 1
                at += 1
        out.sync_errors += n - at
        whole = raw[np.array(found, np.int64)[:, None] + np.arange(PACKET)] if found else raw[:0].reshape(0, PACKET)
    bad = whole[:, 1] & 0x80 > 0
    long = (whole[:, 3] & 0x20 > 0) & (whole[:, 4] > PACKET - 5)  # an adaptation field beyond the packet
    out.sync_errors += int((bad | long).sum())
    return whole if not (bad | long).any() else whole[~(bad | long)]


def _continued(p: np.ndarray, own: np.ndarray, start: np.ndarray, out: Stream) -> tuple[np.ndarray, np.ndarray]:
    """Of one PID's packets with payload those that count once, and which of them follow a gap."""
    cc = p[own, 3] & 15
    step = (cc[1:] - cc[:-1]) & 15
    if (step == 1).all():
        return own, np.zeros(len(own), bool)
    keep, gap, twice = [own[0]], [False], False
    for prev, k, s in zip(own[:-1], own[1:], step.tolist(), strict=True):
        announced = p[k, 3] & 0x20 and p[k, 4] and p[k, 5] & 0x80
        if s == 0 and not twice and not announced and (p[prev, start[prev] :].tobytes() == p[k, start[k] :].tobytes()):
            twice = True
            continue
        twice = False
        jump = s != 1 and not announced
        out.discontinuities += jump
        keep.append(k)
        gap.append(s != 1)
    return np.array(keep), np.array(gap)


def _sections(p: np.ndarray, start: np.ndarray, own: np.ndarray, out: Stream) -> list[bytes]:
    """Distinct sections of one PID with a right checksum, over as many packets as they take."""
    found: dict[bytes, None] = {}
    held: bytes | None = None

    def read(buf: bytes) -> bytes:
        while len(buf) >= 3 and buf[0] != 0xFF:
            size = 3 + ((buf[1] & 15) << 8 | buf[2])
            if len(buf) < size:
                return buf
            if size < 12 or crc_mpeg(buf[: size - 4]) != int.from_bytes(buf[size - 4 : size], "big"):
                out.crc_errors += 1
            else:
                found[buf[:size]] = None
            buf = buf[size:]
        return b""

    if not len(own):
        return []
    for k, gap in zip(*_continued(p, own, start, out), strict=True):
        body = p[k, start[k] :].tobytes()
        held = None if gap else held
        if p[k, 1] & 0x40 and body:
            if held is not None:
                read(held + body[1 : 1 + body[0]])
            held = read(body[1 + body[0] :])
        elif held:
            held = read(held + body)
    return list(found)


def demux(media: bytes) -> Stream:
    out = Stream()
    p = _aligned(media, out)
    out.packets = len(p)
    if not len(p):
        return out
    pid = (p[:, 1].astype(np.int64) & 31) << 8 | p[:, 2]
    adapt, has = p[:, 3] & 0x20 > 0, p[:, 3] & 0x10 > 0
    start = 4 + np.where(adapt, p[:, 4].astype(np.int64) + 1, 0)
    of = lambda x: np.flatnonzero((pid == x) & has)
    read = set()
    for pat in _sections(p, start, of(PAT_PID), out):
        if pat[0] != 0:
            continue
        for i in range(8, len(pat) - 4, 4):
            number, pmt_pid = struct.unpack(">HH", pat[i : i + 4])
            if not number or pmt_pid & 0x1FFF in read:
                continue
            read.add(pmt_pid & 0x1FFF)
            for pmt in _sections(p, start, of(pmt_pid & 0x1FFF), out):
                if pmt[0] != 2:
                    continue
                i, program = 12 + (int.from_bytes(pmt[10:12], "big") & 0xFFF), int.from_bytes(pmt[3:5], "big")
                while i + 5 <= len(pmt) - 4:
                    kind, es, info = struct.unpack(">BHH", pmt[i : i + 5])
                    out.programs.setdefault(program, {})[es & 0x1FFF] = kind
                    i += 5 + (info & 0xFFF)
    parts = []
    for es in sorted({x for prog in out.programs.values() for x in prog}):
        own = of(es)
        if not len(own):
            continue
        own, gap = _continued(p, own, start, out)
        size = PACKET - start[own]
        data = p.ravel()[ragged(own * PACKET + start[own], size)]
        first = np.flatnonzero(p[own, 1] & 0x40 > 0)
        at = (np.cumsum(size) - size)[first]
        torn = np.cumsum(gap)
        for j, (a, b, k) in enumerate(zip(at, [*at[1:], len(data)], own[first], strict=True)):
            last = first[j + 1] - 1 if j + 1 < len(first) else len(own) - 1
            head = data[a : min(b, a + 14)].tobytes()
            length = int.from_bytes(head[4:6], "big") if len(head) >= 9 else 0
            body, end = a + 9 + head[8] if len(head) >= 9 else b, a + 6 + length if length else b
            if head[:3] != b"\0\0\1" or torn[last] > torn[first[j]] or end > b or body > end:
                out.lost_units += 1
                continue
            parts.append(data[body:end].tobytes())
            h = head[9:14]
            out.pts.append((h[0] >> 1 & 7) << 30 | h[1] << 22 | h[2] >> 1 << 15 | h[3] << 7 | h[4] >> 1 if head[7] & 0x80 and len(h) == 5 else -1)
            out.random_access.append(bool(adapt[k] and p[k, 4] and p[k, 5] & 0x40))
            out.packet_index.append(int(k))
    out.payload = b"".join(parts)
    return out


def store(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes, media (the stream), payload (read back from it), units (pts, packet, random access), feature."""
    unit = pa.struct([("pts", pa.int64()), ("packet", pa.int32()), ("random_access", pa.bool_())])

    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        texts = texts_of(b.column(1))
        media = [mux(t.ljust(max(1, -(-len(t) // UNIT)) * UNIT, b"\0")) for t in texts]
        read = [demux(m) for m in media]
        flat = [(a, k, r) for s in read for a, k, r in zip(s.pts, s.packet_index, s.random_access, strict=True)]
        offsets = pa.array(np.r_[0, np.cumsum([len(s.pts) for s in read])].astype(np.int32))
        cols = [pa.array([x[i] for x in flat], unit.field(i).type) for i in range(3)]
        units = pa.ListArray.from_arrays(offsets, pa.StructArray.from_arrays(cols, fields=list(unit)))
        return pa.RecordBatch.from_arrays([b.column(0), pa.array([len(t) for t in texts], pa.int64()), pa.array(media, pa.binary()), pa.array([s.payload for s in read], pa.binary()), units, pa.array([s.feature() for s in read])], ["doc_id", "n_bytes", "media", "payload", "units", "feature"])

    src = df.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    kind = dict(src.dtypes)["doc_id"]
    return map_batches(src, run, f"doc_id {kind}, n_bytes long, media binary, payload binary, units array<struct<pts:long,packet:int,random_access:boolean>>, feature string")


def op5_transport_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = store(table(spark, sf_dir, "documents"))
    return s.select("doc_id", "n_bytes", F.length("payload").cast("long").alias("payload_bytes"), F.sha2("payload", 256).alias("payload_sha256"), F.crc32(F.expr("substring(payload, -64, 64)")).alias("tail_crc32"), F.length("media").cast("long").alias("media_bytes"), F.sha2("media", 256).alias("media_sha256"), "feature")


QUERIES = {"op5_transport_stream": op5_transport_stream}
ORACLE_SQL: dict[str, str] = {}
