"""Media columns: MPEG transport streams.

:func:`demux` reads a 188-byte packet stream: it finds the program map through
the association table, checks section checksums and continuity counters,
reassembles elementary packets, and lists each access unit with its time stamp
and whether it begins at a random-access point. :func:`mux` writes such a
stream, losslessly, from a payload. Both are small helpers; Spark deals the
rows (:func:`transport_streams`, :func:`access_units`).

Defined results for odd input: a null payload text counts as empty and is
stored as one pad of 192 blanks; equal payloads give equal streams. A packet sent twice counts once, and a jump
of the counter that a packet announces is no error. Bytes that are not whole packets, packets without the sync byte, damaged sections and
elementary packets are counted as errors, not raised. A null stream has no
access units. Repeated rows are kept, columns other than those named are
ignored, an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import zlib
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

PACKET, SYNC = 188, 0x47
PAD_TO = 192
PMT_PID, ES_PID, NULL_PID = 0x0100, 0x0101, 0x1FFF
#: Private data in elementary packets, and its stream id.
STREAM_TYPE, STREAM_ID = 0x06, 0xBD
#: Payload bytes of an access unit; 90 kHz ticks between units; units from one random-access point to the next.
UNIT, TICKS, RANDOM_ACCESS = 16 * 192, 3600, 8


@lru_cache(maxsize=256)
def section_crc(data: bytes) -> int:
    """CRC-32 of program sections: polynomial 04C11DB7, most significant bit first, no final inversion."""
    crc = 0xFFFFFFFF
    for byte in data:
        crc ^= byte << 24
        for _ in range(8):
            crc = (crc << 1 ^ 0x04C11DB7 if crc & 0x80000000 else crc << 1) & 0xFFFFFFFF
    return crc


def _section(body: bytes, table_id: int, number: int) -> bytes:
    head = bytes([table_id]) + (0xB000 | len(body) + 9).to_bytes(2, "big") + number.to_bytes(2, "big") + b"\xc1\x00\x00"
    return head + body + section_crc(head + body).to_bytes(4, "big")


@lru_cache(maxsize=4)
def _tables() -> tuple[bytes, bytes]:
    """Packets of the association table and of the program map; the continuity counter is set later."""
    pat = _section((1).to_bytes(2, "big") + (0xE000 | PMT_PID).to_bytes(2, "big"), 0, 1)
    es = bytes([STREAM_TYPE]) + (0xE000 | ES_PID).to_bytes(2, "big") + b"\xf0\x00"
    pmt = _section((0xE000 | ES_PID).to_bytes(2, "big") + b"\xf0\x00" + es, 2, 1)
    out = []
    for pid, section in ((0, pat), (PMT_PID, pmt)):
        packet = bytes([SYNC]) + (0x4000 | pid).to_bytes(2, "big") + b"\x10\x00" + section
        out.append(packet.ljust(PACKET, b"\xff"))
    return out[0], out[1]


def _stamp(prefix: int, t: int) -> bytes:
    return bytes([prefix << 4 | (t >> 30 & 7) << 1 | 1, t >> 22 & 255, (t >> 15 & 127) << 1 | 1, t >> 7 & 255, (t & 127) << 1 | 1])


def _clock(t: int) -> bytes:
    """Program clock reference: 33 bits of 90 kHz, 6 reserved bits, 9 bits of extension."""
    return (t << 15 | 0x3F << 9).to_bytes(6, "big")


def mux(payload: bytes, unit: int = UNIT) -> bytes:
    """A transport stream of one program with one elementary stream that carries ``payload``."""
    out, counter, tables = [], 0, 0
    for number, at in enumerate(range(0, len(payload), unit)):
        random_access = number % RANDOM_ACCESS == 0
        t = (number + 1) * TICKS
        if random_access:
            for packet in _tables():
                out.append(packet[:3] + bytes([0x10 | tables & 15]) + packet[4:])
            tables += 1
        data = payload[at : at + unit]
        body = b"\x00\x00\x01" + bytes([STREAM_ID]) + (len(data) + 8).to_bytes(2, "big") + b"\x84\x80\x05" + _stamp(2, t) + data
        adapt = bytes([0x50]) + _clock(t - TICKS) if random_access else b""
        first = 184 - (1 + len(adapt) if adapt else 0)
        sizes = [min(first, len(body))]
        sizes += [184] * ((len(body) - sizes[0]) // 184)
        if rest := len(body) - sum(sizes):
            sizes.append(rest)
        put = 0
        for k, size in enumerate(sizes):
            field = adapt if k == 0 else b""
            control, room = 0x10, 184 - size
            if room:
                control = 0x30
                field = bytes([room - 1]) + ((field or b"\x00").ljust(room - 1, b"\xff") if room > 1 else b"")
            out.append(bytes([SYNC]) + ((0x4000 if k == 0 else 0) | ES_PID).to_bytes(2, "big") + bytes([control | counter & 15]) + field + body[put : put + size])
            counter += 1
            put += size
    return b"".join(out)


def sections(payloads):
    """The sections, without their checksums, of a table's packets ``(begins a section, payload)``; None for a damaged one.

    A section may go on over several packets, and a packet may hold several.
    """
    held = None
    for starts, data in payloads:
        if starts:
            pointer = data[0] if data else 0
            if held:
                held += data[1 : 1 + pointer]
                if len(held) < 3 or len(held) < _section_size(held):
                    yield None
                else:
                    yield _checked(held[: _section_size(held)])
            held = data[1 + pointer :]
        elif held is not None:
            held += data
        while held and held[0] != 0xFF and len(held) >= 3 and len(held) >= (size := _section_size(held)):
            yield _checked(held[:size])
            held = held[size:]
        if held and held[0] == 0xFF:  # stuffing up to the next start
            held = None
    if held:
        yield None


def _section_size(data: bytes) -> int:
    return 3 + (int.from_bytes(data[1:3], "big") & 0x0FFF)


def _checked(section: bytes) -> bytes | None:
    if len(section) < 12 or section_crc(bytes(section[:-4])) != int.from_bytes(section[-4:], "big"):
        return None
    return section[:-4]


def continuity(payloads: np.ndarray, counters: np.ndarray, told: np.ndarray) -> tuple[np.ndarray, int]:
    """Which packets of a stream are repeats of the one before, and how many counters are out of order.

    A packet may be sent twice, once in a row; ``told`` are packets that announce a jump.
    """
    step = np.diff(counters.astype(int)) % 16
    same = np.concatenate([[False], (step == 0) & (payloads[1:] == payloads[:-1]).all(1)])
    for k in np.flatnonzero(same[1:] & same[:-1]) + 1:  # a second repeat is an error
        same[k] = same[k] and not same[k - 1]
    return same, int(((step != 1) & ~same[1:] & ~told[1:]).sum())


def demux(stream: bytes | None) -> dict:
    """Programs, errors and access units of a transport stream.

    Units are ``(pid, pts, random_access, data)`` in the order of their first packets.
    """
    stream = stream or b""
    whole = np.frombuffer(stream, np.uint8)[: len(stream) // PACKET * PACKET].reshape(-1, PACKET)
    good = (whole[:, 0] == SYNC) & (whole[:, 1] & 0x80 == 0)
    found = {"packets": len(whole), "sync_errors": int((~good).sum()) + (len(stream) % PACKET > 0), "continuity_errors": 0, "table_errors": 0, "packet_errors": 0, "programs": {}, "streams": {}, "units": []}
    p = whole[good]
    if not len(p):
        return found
    pid = (p[:, 1].astype(int) & 0x1F) << 8 | p[:, 2]
    starts, control, counter = p[:, 1] & 0x40 > 0, p[:, 3] >> 4 & 3, p[:, 3] & 15
    skip = np.where(control & 2, p[:, 4].astype(int) + 1, 0)
    loaded = (control & 1 > 0) & (skip < 184)

    def payload(k: int) -> bytes:
        return p[k, 4 + skip[k] :].tobytes()

    told = (control & 2 > 0) & (p[:, 4] > 0) & (p[:, 5] & 0x80 > 0)
    for one in np.unique(pid):
        mine = np.flatnonzero((pid == one) & (control & 1 > 0))
        if len(mine) and one != NULL_PID:
            repeats, errors = continuity(p[mine, 4:], counter[mine], told[mine])
            loaded[mine[repeats]] = False
            found["continuity_errors"] += errors

    def tables(of: int):
        for s in sections((bool(starts[k]), payload(k)) for k in np.flatnonzero((pid == of) & loaded)):
            if s is None:
                found["table_errors"] += 1
            else:
                yield s

    for s in tables(0):
        for at in range(8, len(s) - 3, 4):
            if number := int.from_bytes(s[at : at + 2], "big"):
                found["programs"][number] = int.from_bytes(s[at + 2 : at + 4], "big") & 0x1FFF
    for map_pid in sorted(set(found["programs"].values())):
        for s in tables(map_pid):
            at = 12 + (int.from_bytes(s[10:12], "big") & 0x0FFF)
            while at + 5 <= len(s):
                found["streams"][int.from_bytes(s[at + 1 : at + 3], "big") & 0x1FFF] = s[at]
                at += 5 + (int.from_bytes(s[at + 3 : at + 5], "big") & 0x0FFF)
    units = []
    for one in found["streams"]:
        mine = np.flatnonzero((pid == one) & loaded)
        heads = np.flatnonzero(starts[mine])
        for a, b in zip(heads, [*heads[1:], len(mine)]):
            ks = mine[a:b]
            random_access = bool(control[ks[0]] & 2 and p[ks[0], 4] and p[ks[0], 5] & 0x40)
            middle = ks[1:-1]
            if len(middle) and not skip[middle].any():
                data = payload(ks[0]) + p[middle, 4:].tobytes() + payload(ks[-1])
            else:
                data = b"".join(map(payload, ks))
            if len(data) < 9 or data[:3] != b"\x00\x00\x01":
                found["packet_errors"] += 1
                continue
            end, begin, pts = int.from_bytes(data[4:6], "big"), 9 + data[8], None
            if data[7] & 0x80 and len(data) >= 14:
                x = data[9:14]
                pts = (x[0] >> 1 & 7) << 30 | x[1] << 22 | x[2] >> 1 << 15 | x[3] << 7 | x[4] >> 1
            if end and 6 + end > len(data):
                found["packet_errors"] += 1
            units.append((int(ks[0]), int(one), pts, random_access, data[begin : 6 + end if end else None]))
    found["units"] = [u[1:] for u in sorted(units, key=lambda u: u[:2])]
    return found


def describe(found: dict) -> str:
    """What a demultiplexed stream holds, as ``name=value`` pairs."""
    times = [u[1] for u in found["units"] if u[1] is not None]
    return ";".join(f"{k}={v}" for k, v in {
        "programs": len(found["programs"]),
        "streams": ",".join(f"{pid}:{kind}" for pid, kind in sorted(found["streams"].items())),
        "packets": found["packets"],
        "units": len(found["units"]),
        "random_access": ",".join(str(u[1]) for u in found["units"] if u[2]),
        "first_pts": min(times, default=""),
        "last_pts": max(times, default=""),
        "errors": found["sync_errors"] + found["continuity_errors"] + found["table_errors"] + found["packet_errors"],
    }.items())


def stream_of(payload: Column) -> Column:
    """A binary column as transport streams; null counts as empty."""

    @F.pandas_udf("binary")
    def streams(payloads: pd.Series) -> pd.Series:
        return pd.Series([mux(x or b"") for x in payloads])

    return streams(payload)


def units_of(stream: Column) -> Column:
    """The access units of a column of transport streams, in order."""

    @F.pandas_udf("array<struct<unit: int, pid: int, pts: bigint, random_access: boolean, data: binary>>")
    def units(streams: pd.Series) -> pd.Series:
        names = ("unit", "pid", "pts", "random_access", "data")
        return pd.Series([[dict(zip(names, (n, *u))) for n, u in enumerate(demux(s)["units"])] for s in streams])

    return units(stream)


def transport_streams(df: DataFrame, key: str, payload: str) -> DataFrame:
    """``key`` and ``stream``: the binary column ``payload`` (null: empty) as transport streams."""
    return df.select(F.col(key), stream_of(F.col(payload)).alias("stream"))


def access_units(df: DataFrame, key: str, stream: str = "stream") -> DataFrame:
    """One row for each access unit of the binary column ``stream``."""
    return df.select(F.col(key), F.explode(units_of(F.col(stream))).alias("found")).select(F.col(key), "found.*")


DIGEST = "payload_bytes: bigint, payload_sha256: string, tail_crc32: bigint, media_bytes: bigint, media_sha256: string, feature: string"


def op3_transport_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts as transport streams: stored, read back and described."""
    docs = table(spark, sf_dir, "documents").select("doc_id", F.encode(F.coalesce("text", F.lit("")), "UTF-8").alias("raw"))
    size = F.octet_length("raw")
    padded = F.rpad("raw", F.greatest(F.lit(1), F.ceil(size / PAD_TO)).cast("int") * PAD_TO, F.lit(b" "))
    streams = docs.select("doc_id", size.cast("bigint").alias("n_bytes"), stream_of(padded).alias("stream"))

    @F.pandas_udf(f"struct<{DIGEST}>")
    def digest(stored: pd.Series) -> pd.DataFrame:
        rows = []
        for stream in stored:
            found = demux(stream)
            back = b"".join(u[3] for u in found["units"])
            rows.append((len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-16:]), len(stream), hashlib.sha256(stream).hexdigest(), describe(found)))
        return pd.DataFrame(rows, columns=[c.split(":")[0] for c in DIGEST.split(", ")])

    return streams.select("doc_id", "n_bytes", digest("stream").alias("digest")).select("doc_id", "n_bytes", "digest.*")


QUERIES = {"op3_transport_stream": op3_transport_stream}
