"""Matroska files in a binary column: write samples, read packet tables.

The reader walks EBML elements with their variable-length ids and sizes, down through segment,
tracks, clusters, block groups and cues, undoes the three kinds of lacing, and gives each packet's
track, time and byte range in the file; frames of a lace follow one another by their track's default
duration. The writer stores 8-bit PCM in laced blocks with cues. A block of a group is a key frame
unless the group names another block that it refers to.

Defined cases: null media is one row without a packet and a null error; media that is cut short or
not Matroska gives the packets before the fault and an error text, one row at least; an empty text
is one frame of blanks; other columns pass through, but one named like a column of the table is
replaced; a null id is kept, repeated rows are read each; empty tables stay empty.
"""

from __future__ import annotations

import hashlib
import struct
import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barloom.llm.tokens import steps

# Fixed values of the format: element ids.
EBML, DOC_TYPE, SEGMENT, INFO, SCALE, DURATION = 0x1A45DFA3, 0x4282, 0x18538067, 0x1549A966, 0x2AD7B1, 0x4489
TRACKS, TRACK, NUMBER, UID, KIND, CODEC = 0x1654AE6B, 0xAE, 0xD7, 0x73C5, 0x83, 0x86
AUDIO, RATE, CHANNELS, DEPTH = 0xE1, 0xB5, 0x9F, 0x6264
CLUSTER, TIME, SIMPLE, GROUP, BLOCK, REFERENCE = 0x1F43B675, 0xE7, 0xA3, 0xA0, 0xA1, 0xFB
FRAME_TIME = 0x23E383
CUES, CUE, CUE_TIME, CUE_PLACE, CUE_TRACK, CUE_CLUSTER = 0x1C53BB6B, 0xBB, 0xB3, 0xB7, 0xF7, 0xF1
NESTED = {SEGMENT, TRACKS, TRACK, CLUSTER, GROUP, CUES, CUE, CUE_PLACE, INFO}
#: Elements that end a cluster or segment of unknown size.
TOP = {CLUSTER, CUES, TRACKS, INFO, SEGMENT, EBML}

#: Bytes of a frame, frames of a block, blocks of a cluster, samples a second of what is written here.
FRAME, LACED, BLOCKS, HERTZ = 192, 32, 16, 8000


def number(data: bytes, at: int, marker: bool) -> tuple[int, int]:
    """(value, next offset) of a variable-length number; ids keep their marker bit; -1: unknown size."""
    if at >= len(data) or not data[at]:
        raise ValueError(f"no number at byte {at}")
    width = 9 - data[at].bit_length()
    if at + width > len(data):
        raise ValueError(f"cut short at byte {at}")
    value = int.from_bytes(data[at : at + width], "big")
    if marker:
        return value, at + width
    value &= (1 << 7 * width) - 1
    return (-1 if value == (1 << 7 * width) - 1 else value), at + width


def laces(data: bytes, at: int, end: int, kind: int) -> list[tuple[int, int]]:
    """(start, length) of the frames of a block's body."""
    if not kind:
        return [(at, end - at)]
    n, at = data[at] + 1, at + 1
    if kind == 2:  # all of one size
        each, over = divmod(end - at, n)
        if over:
            raise ValueError(f"uneven lace at byte {at}")
        return [(at + i * each, each) for i in range(n)]
    sizes = []
    for i in range(n - 1):
        if kind == 1:  # bytes of 255 go on
            size = 0
            while data[at] == 255:
                size, at = size + 255, at + 1
            size, at = size + data[at], at + 1
        else:  # the first size, then signed steps
            start = at
            value, at = number(data, at, False)
            size = value if i == 0 else sizes[-1] + value - ((1 << (7 * (at - start) - 1)) - 1)
        sizes.append(size)
    sizes.append(end - at - sum(sizes))
    if min(sizes) < 0:
        raise ValueError(f"lace too long at byte {at}")
    starts = np.concatenate([[0], np.cumsum(sizes[:-1])]) + at
    return list(zip(starts.tolist(), sizes, strict=True))


def parse(data: bytes) -> dict:
    """packets (track, ms, start, length, key), cues (ms, track, byte), tracks (number, kind, codec, rate), clusters, error."""
    out: dict = {"packets": [], "cues": [], "tracks": [], "clusters": [], "error": None}
    scale, base, segment, cue = 1_000_000, 0, 0, [0, 0, 0]
    ends = [len(data)]
    ids = [0]
    at, group = 0, None
    try:
        if number(data, 0, True)[0] != EBML:
            raise ValueError("not EBML")
        while at < len(data):
            while at >= ends[-1] and len(ends) > 1:
                ends.pop()
                if ids.pop() == CUE_PLACE:
                    out["cues"].append((cue[0] * scale // 1_000_000, cue[1], segment + cue[2]))
            first = at
            name, at = number(data, at, True)
            size, at = number(data, at, False)
            while name in TOP and len(ids) > 1 and ids[-1] in (CLUSTER, CUES) and ends[-1] == len(data):
                ends.pop()
                ids.pop()
            end = len(data) if size < 0 else at + size
            if end > len(data):
                raise ValueError(f"element at byte {first} is cut short")
            if name in NESTED:
                if name == SEGMENT:
                    segment = at
                elif name == CLUSTER:
                    out["clusters"].append(first)
                elif name == TRACK:
                    out["tracks"].append({})
                elif name == GROUP:
                    group = None
                ends.append(end)
                ids.append(name)
                continue
            value = data[at:end]
            if name in (SIMPLE, BLOCK):
                track, body = number(data, at, False)
                (step,) = struct.unpack(">h", data[body : body + 2])
                flags = data[body + 2]
                frames = laces(data, body + 3, end, flags >> 1 & 3)
                each = next((t.get(FRAME_TIME, 0) for t in out["tracks"] if t.get(NUMBER) == track), 0)
                group = len(out["packets"])
                out["packets"] += [(track, ((base + step) * scale + i * each) // 1_000_000, s, n, name == BLOCK or bool(flags & 0x80)) for i, (s, n) in enumerate(frames)]
            elif name == REFERENCE and group is not None:
                out["packets"][group:] = [(*p[:4], False) for p in out["packets"][group:]]
            elif name == TIME:
                base = int.from_bytes(value, "big")
            elif name == SCALE:
                scale = int.from_bytes(value, "big")
            elif name in (NUMBER, KIND, FRAME_TIME):
                out["tracks"][-1][name] = int.from_bytes(value, "big")
            elif name == CODEC:
                out["tracks"][-1][name] = value.decode("ascii", "replace")
            elif name in (CUE_TIME, CUE_TRACK, CUE_CLUSTER):
                cue[(CUE_TIME, CUE_TRACK, CUE_CLUSTER).index(name)] = int.from_bytes(value, "big")
            at = end
        if ids[-1] == CUE_PLACE:
            out["cues"].append((cue[0] * scale // 1_000_000, cue[1], segment + cue[2]))
    except (ValueError, IndexError, struct.error) as e:
        out["error"] = str(e)
    return out


def element(name: int, body: bytes) -> bytes:
    width = next(w for w in range(1, 9) if len(body) < (1 << 7 * w) - 1)
    return name.to_bytes((name.bit_length() + 7) // 8, "big") + ((1 << 7 * width) | len(body)).to_bytes(width, "big") + body


def whole(name: int, value: int) -> bytes:
    return element(name, value.to_bytes(max(1, (value.bit_length() + 7) // 8), "big"))


def write_pcm(payload: bytes) -> bytes:
    """8-bit mono PCM of whole frames as a Matroska file: laced blocks in clusters, then cues."""
    if not payload or len(payload) % FRAME:
        raise ValueError(f"{len(payload)} bytes are no whole frames of {FRAME}")
    audio = element(AUDIO, element(RATE, struct.pack(">d", HERTZ)) + whole(CHANNELS, 1) + whole(DEPTH, 8))
    track = element(TRACK, whole(NUMBER, 1) + whole(UID, 1) + whole(KIND, 2) + whole(FRAME_TIME, FRAME * 1_000_000_000 // HERTZ) + element(CODEC, b"A_PCM/INT/LIT") + audio)
    parts = [element(INFO, whole(SCALE, 1_000_000)), element(TRACKS, track)]
    size, cues = sum(map(len, parts)), []
    step = FRAME * LACED
    for c in range(0, len(payload), step * BLOCKS):
        body = [whole(TIME, c * 1000 // HERTZ)]
        for b in range(c, min(len(payload), c + step * BLOCKS), step):
            frames = payload[b : b + step]
            head = b"\x81" + struct.pack(">h", (b - c) * 1000 // HERTZ)
            body.append(element(SIMPLE, head + (b"\x84" + bytes([len(frames) // FRAME - 1]) if len(frames) > FRAME else b"\x80") + frames))
        parts.append(element(CLUSTER, b"".join(body)))
        cues.append(element(CUE, whole(CUE_TIME, c * 1000 // HERTZ) + element(CUE_PLACE, whole(CUE_TRACK, 1) + whole(CUE_CLUSTER, size))))
        size += len(parts[-1])
    return element(EBML, element(DOC_TYPE, b"matroska")) + element(SEGMENT, b"".join(parts) + element(CUES, b"".join(cues)))


def store_texts(docs: DataFrame) -> DataFrame:
    """(doc_id, n_bytes, media): each whole text's UTF-8, filled up with blanks to whole frames, as a media column."""

    def rows(batches):
        for batch in batches:
            for part in steps(batch, "text"):
                sizes, media = [], []
                for text in part.column("text").to_pylist():
                    raw = (text or "").encode()
                    sizes.append(len(raw))
                    media.append(write_pcm(raw + b" " * (max(FRAME, -(-len(raw) // FRAME) * FRAME) - len(raw))))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(sizes, pa.int64()), pa.array(media, pa.binary())], ["doc_id", "n_bytes", "media"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(rows, "doc_id long, n_bytes long, media binary")


TABLES = {"packets": ("track int, ms long, start long, length long, key boolean", 5), "cues": ("ms long, track int, start long", 3)}


def listed(media: DataFrame, column: str, what: str) -> DataFrame:
    fields, n = TABLES[what]
    names = [f.split()[0] for f in fields.split(", ")]

    @F.pandas_udf(f"struct<rows:array<struct<{', '.join(f.replace(' ', ':') for f in fields.split(', '))}>>,error:string>")
    def table(files: pd.Series) -> pd.DataFrame:
        found = [None if b is None else parse(bytes(b)) for b in files]
        return pd.DataFrame({"rows": [None if f is None else [dict(zip(names, p, strict=True)) for p in f[what]] for f in found], "error": [f and f["error"] for f in found]})

    others = [c for c in media.columns if c not in (column, "error", *names)]
    # other columns go as one, so that none of them can have a name used here
    out = media.select(F.struct(*[F.col(f"`{c}`") for c in others]).alias("others"), table(F.col(f"`{column}`")).alias("found"))
    out = out.select("others", F.explode_outer("found.rows").alias("row"), F.col("found.error").alias("error"))
    return out.select(*[F.col("others").getField(c).alias(c) for c in others], "row.*", "error")


def packets(media: DataFrame, column: str = "media") -> DataFrame:
    """A row for each packet, with all columns but the media, and the file's error; start and length are bytes of the file."""
    return listed(media, column, "packets")


def cues(media: DataFrame, column: str = "media") -> DataFrame:
    """A row for each cue: the time and track to seek, and the byte at which its cluster starts."""
    return listed(media, column, "cues")


def features(samples: np.ndarray, found: dict) -> str:
    """Packets, clusters, cues and length, and whole-number statistics of the samples around their middle."""
    x = samples.astype(np.int64) - 128
    ms = max((p[1] for p in found["packets"]), default=0)
    turns = int(np.count_nonzero(np.diff(samples > np.uint8(127))))
    return f"packets={len(found['packets'])};clusters={len(found['clusters'])};cues={len(found['cues'])};last_ms={ms};sum={int(x.sum())};energy={int((x * x).sum())};peak={int(np.abs(x).max(initial=0))};crossings={turns}"


def read_back(media: DataFrame) -> DataFrame:
    """Digests of what the stored files hold, their packets put together again; of a damaged file only its error and its own digest."""

    def row(raw: bytes | None) -> tuple:
        if raw is None:
            return (None,) * 7
        found = parse(raw)
        stored = (len(raw), hashlib.sha256(raw).hexdigest())
        if found["error"]:
            return None, None, None, *stored, None, found["error"]
        payload = b"".join(raw[s : s + n] for _, _, s, n, _ in found["packets"])
        return len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]), *stored, features(np.frombuffer(payload, np.uint8), found), None

    types = {"payload_bytes": pa.int64(), "payload_sha256": pa.string(), "tail_crc32": pa.int64(), "media_bytes": pa.int64(), "media_sha256": pa.string(), "feature": pa.string(), "error": pa.string()}

    def rows(batches):
        for b in batches:
            columns = zip(*map(row, b.column("media").to_pylist()), strict=True) if b.num_rows else [()] * len(types)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("n_bytes"), *(pa.array(c, t) for c, t in zip(columns, types.values(), strict=True))], ["doc_id", "n_bytes", *types])

    schema = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, error string"
    return media.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("n_bytes").cast("long").alias("n_bytes"), "media").mapInArrow(rows, schema)
