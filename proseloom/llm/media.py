"""Operator 1: Matroska media columns: write payloads as Matroska, parse stored bytes into packet tables.

``parse`` reads variable-length EBML elements (ids, sizes, unknown sizes of Segment and Cluster), Info, Tracks,
Clusters with SimpleBlock and BlockGroup, all four lacings (none, Xiph, fixed, EBML), and Cues. A packet has its track,
timestamp in nanoseconds, duration, flags and its byte range in the stored file, so a reader can fetch it alone.

Malformed bytes: ``parse`` raises ValueError; ``packets`` gives one row with the error and null packet columns, and
``features`` a row whose feature is the error. Null media: no packets, and a row of nulls in ``features``. Null or empty
texts: a payload of 64 zero bytes. Repeated rows keep their own packets. Empty table: empty result. Extra columns are
ignored.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import keyed_texts, staged, table, with_nulls

RATE, FRAME, LACED, BLOCKS, UNIT = 8000, 256, 8, 4, 64
# Element ids of the public Matroska specification (RFC 9559), fixed values.
EBML, EBML_VERSION, EBML_READ, EBML_IDLEN, EBML_SIZELEN, DOCTYPE, DOC_VERSION, DOC_READ = 0x1A45DFA3, 0x4286, 0x42F7, 0x42F2, 0x42F3, 0x4282, 0x4287, 0x4285
SEGMENT, INFO, SCALE, DURATION, TRACKS, ENTRY, NUMBER, UID, KIND, CODEC, DEFAULT_NS, LACING = 0x18538067, 0x1549A966, 0x2AD7B1, 0x4489, 0x1654AE6B, 0xAE, 0xD7, 0x73C5, 0x83, 0x86, 0x23E383, 0x9C
AUDIO, SAMPLING, CHANNELS, DEPTH = 0xE1, 0xB5, 0x9F, 0x6264
CLUSTER, TIMESTAMP, SIMPLE, GROUP, BLOCK, BLOCK_DURATION, REFERENCE = 0x1F43B675, 0xE7, 0xA3, 0xA0, 0xA1, 0x9B, 0xFB
CUES, CUE, CUE_TIME, CUE_AT, CUE_TRACK, CUE_CLUSTER = 0x1C53BB6B, 0xBB, 0xB3, 0xB7, 0xF7, 0xF1
TOP = {CLUSTER, CUES, INFO, TRACKS, SEGMENT, EBML, 0x114D9B74, 0x1254C367, 0x1941A469, 0x1043A770}


def id_bytes(i: int) -> bytes:
    return i.to_bytes((i.bit_length() + 7) // 8, "big")


def size_bytes(n: int) -> bytes:
    for w in range(1, 9):
        if n < (1 << 7 * w) - 1:
            return (n | 1 << 7 * w).to_bytes(w, "big")
    raise ValueError("element too large")


def element(i: int, body: bytes) -> bytes:
    return id_bytes(i) + size_bytes(len(body)) + body


def uint(i: int, n: int) -> bytes:
    return element(i, n.to_bytes(max(1, (n.bit_length() + 7) // 8), "big"))


def signed_size(n: int) -> bytes:
    for w in range(1, 9):
        half = (1 << 7 * w - 1) - 1
        if -half <= n <= half:
            return (n + half | 1 << 7 * w).to_bytes(w, "big")
    raise ValueError("lace too large")


def lace(frames: list[bytes]) -> tuple[int, bytes]:
    """The tightest lacing: none for one frame, fixed for equal sizes, Xiph or EBML else. Flag bits and body."""
    if len(frames) == 1:
        return 0, frames[0]
    head, sizes, body = bytes([len(frames) - 1]), [len(f) for f in frames], b"".join(frames)
    if len(set(sizes)) == 1:
        return 0x04, head + body
    ebml = size_bytes(sizes[0]) + b"".join(signed_size(b - a) for a, b in zip(sizes, sizes[1:-1], strict=False))
    xiph = b"".join(b"\xff" * (n // 255) + bytes([n % 255]) for n in sizes[:-1])
    return (0x02, head + xiph + body) if len(xiph) < len(ebml) else (0x06, head + ebml + body)


_HEAD = element(EBML, uint(EBML_VERSION, 1) + uint(EBML_READ, 1) + uint(EBML_IDLEN, 4) + uint(EBML_SIZELEN, 8) + element(DOCTYPE, b"matroska") + uint(DOC_VERSION, 4) + uint(DOC_READ, 2))
_TRACKS = element(TRACKS, element(ENTRY, uint(NUMBER, 1) + uint(UID, 1) + uint(KIND, 2) + element(CODEC, b"A_PCM/INT/LIT") + uint(DEFAULT_NS, FRAME * 10**9 // RATE) + uint(LACING, 1) + element(AUDIO, element(SAMPLING, np.array([RATE], ">f8").tobytes()) + uint(CHANNELS, 1) + uint(DEPTH, 8))))


def mux(payload: bytes) -> bytes:
    """The payload as 8-bit mono samples: blocks of laced frames, clusters of blocks, a cue for each cluster.

    One timestamp tick is one frame (32 ms)."""
    tick = FRAME * 10**9 // RATE
    info = element(INFO, uint(SCALE, tick) + element(DURATION, np.array([len(payload) / FRAME], ">f8").tobytes()))
    step = FRAME * LACED
    clusters, cues, at = [], [], len(info) + len(_TRACKS)
    for c, begin in enumerate(range(0, len(payload), step * BLOCKS)):
        time = c * LACED * BLOCKS
        blocks = [uint(TIMESTAMP, time)]
        for b, start in enumerate(range(begin, min(begin + step * BLOCKS, len(payload)), step)):
            flags, body = lace([payload[i : min(i + FRAME, start + step)] for i in range(start, min(start + step, len(payload)), FRAME)])
            blocks.append(element(SIMPLE, b"\x81" + (b * LACED).to_bytes(2, "big", signed=True) + bytes([0x80 | flags]) + body))
        cluster = element(CLUSTER, b"".join(blocks))
        clusters.append(cluster)
        cues.append(element(CUE, uint(CUE_TIME, time) + element(CUE_AT, uint(CUE_TRACK, 1) + uint(CUE_CLUSTER, at))))
        at += len(cluster)
    return _HEAD + element(SEGMENT, info + _TRACKS + b"".join(clusters) + element(CUES, b"".join(cues)))


def _id(data: bytes, at: int) -> tuple[int, int]:
    n = 9 - data[at].bit_length()
    if n > 4 or at + n > len(data):
        raise ValueError(f"no element id at {at}")
    return int.from_bytes(data[at : at + n], "big"), at + n


def _size(data: bytes, at: int) -> tuple[int | None, int]:
    n = 9 - data[at].bit_length()
    if n > 8 or at + n > len(data):
        raise ValueError(f"no element size at {at}")
    value = int.from_bytes(data[at : at + n], "big") & (1 << 7 * n) - 1
    return (None if value == (1 << 7 * n) - 1 else value), at + n


def elements(data: bytes, at: int, end: int, within: int = 0) -> Iterator[tuple[int, int, int, int]]:
    """(id, start of the element, start and end of its body). An element of unknown size, allowed for Segment and
    Cluster, ends before the next element that can't be its child."""
    while at < end:
        start = at
        i, at = _id(data, at)
        if at >= end:
            raise ValueError("size missing")
        n, at = _size(data, at)
        if n is None:
            stop = end
            if i == CLUSTER:
                inner = at
                while inner < end:
                    j, k = _id(data, inner)
                    if j in TOP:
                        break
                    m, k = _size(data, k)
                    inner = k + (m or 0)
                stop = inner
        else:
            stop = at + n
        if stop > end:
            raise ValueError(f"element 0x{i:X} at {start} runs over its parent")
        yield i, start, at, stop
        at = stop


def laced(data: bytes, at: int, end: int, flags: int) -> list[tuple[int, int]]:
    """Byte ranges of the frames of a block whose header ends at ``at``."""
    kind = flags & 0x06
    if not kind:
        return [(at, end)]
    count, at = data[at] + 1, at + 1
    if kind == 0x04:
        n, over = divmod(end - at, count)
        if over:
            raise ValueError("fixed lacing doesn't divide the block")
        sizes = [n] * count
    else:
        sizes = []
        for k in range(count - 1):
            if kind == 0x02:
                n = 0
                while data[at] == 255:
                    n, at = n + 255, at + 1
                n, at = n + data[at], at + 1
            elif not k:
                n, at = _size(data, at)
            else:
                width = 9 - data[at].bit_length()
                raw, at = _size(data, at)
                n = sizes[-1] + ((1 << 7 * width) - 1 if raw is None else raw) - ((1 << 7 * width - 1) - 1)
            sizes.append(n)
        sizes.append(end - at - sum(sizes))
    if min(sizes) < 0:
        raise ValueError("lace sizes exceed the block")
    out = []
    for n in sizes:
        out.append((at, at + n))
        at += n
    return out


def _num(data: bytes, a: int, b: int) -> int:
    return int.from_bytes(data[a:b], "big")


def parse(data: bytes) -> dict:
    """tracks: {number: {codec, default_ns}}; packets: (track, timestamp_ns, duration_ns, flags, cluster, start, end);
    cues: (timestamp_ns, track, position of the cluster in the file, whether a cluster is there)."""
    out = {"scale": 1_000_000, "duration_ns": None, "tracks": {}, "packets": [], "cues": [], "clusters": []}
    try:
        if len(data) < 4 or _id(data, 0)[0] != EBML:
            raise ValueError("no EBML header")
        for i, _, a, b in elements(data, 0, len(data)):
            if i == SEGMENT:
                _segment(data, a, b, out)
    except (IndexError, KeyError) as fault:  # bytes or elements that are not there
        raise ValueError(f"cut short: {fault}") from fault
    places = set(out["clusters"])
    out["cues"] = [(t * out["scale"], track, pos, pos in places) for t, track, pos in out["cues"]]
    return out


def _segment(data: bytes, a: int, b: int, out: dict) -> None:
    base = a
    for i, start, a, b in elements(data, a, b):
        if i == INFO:
            for j, _, c, d in elements(data, a, b):
                if j == SCALE:
                    out["scale"] = _num(data, c, d)
                elif j == DURATION:
                    out["duration"] = float(np.frombuffer(data[c:d], f">f{d - c}")[0])
            if "duration" in out:
                out["duration_ns"] = round(out["duration"] * out["scale"])
        elif i == TRACKS:
            for j, _, c, d in elements(data, a, b):
                if j == ENTRY:
                    t = {x: (p, q) for x, _, p, q in elements(data, c, d)}
                    out["tracks"][_num(data, *t[NUMBER])] = {"codec": data[slice(*t.get(CODEC, (0, 0)))].decode("ascii", "replace"), "default_ns": _num(data, *t[DEFAULT_NS]) if DEFAULT_NS in t else None}
        elif i == CLUSTER:
            out["clusters"].append(start)
            _cluster(data, a, b, out)
        elif i == CUES:
            for j, _, c, d in elements(data, a, b):
                if j == CUE:
                    time, spots = 0, []
                    for k, _, e, f in elements(data, c, d):
                        if k == CUE_TIME:
                            time = _num(data, e, f)
                        elif k == CUE_AT:
                            t = {x: (p, q) for x, _, p, q in elements(data, e, f)}
                            spots.append((_num(data, *t.get(CUE_TRACK, (0, 0))), base + _num(data, *t.get(CUE_CLUSTER, (0, 0)))))
                    out["cues"] += [(time, *s) for s in spots]


def _cluster(data: bytes, a: int, b: int, out: dict) -> None:
    time, number = 0, len(out["clusters"]) - 1
    for i, _, a, b in elements(data, a, b):
        if i == TIMESTAMP:
            time = _num(data, a, b)
        elif i in (SIMPLE, GROUP):
            span, length, key = (a, b), None, None
            if i == GROUP:
                t = {x: (p, q) for x, _, p, q in elements(data, a, b)}
                if BLOCK not in t:
                    continue
                span, length, key = t[BLOCK], _num(data, *t[BLOCK_DURATION]) if BLOCK_DURATION in t else None, REFERENCE not in t
            track, at = _size(data, span[0])
            relative, flags = int.from_bytes(data[at : at + 2], "big", signed=True), data[at + 2]
            frames = laced(data, at + 3, span[1], flags)
            each = out["tracks"].get(track, {}).get("default_ns") or (length * out["scale"] // len(frames) if length else 0)
            key = bool(flags & 0x80) if key is None else key
            out["packets"] += [(track, (time + relative) * out["scale"] + k * each, each, (0x80 if key else 0) | flags & 0x7F, number, s, e) for k, (s, e) in enumerate(frames)]


def media_column(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, media: every whole text, zero-padded to a positive multiple of 64 bytes, as Matroska."""

    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            raw = [t.encode("utf-8", "surrogatepass") for t in b["text"]]
            yield b[["has_id", "doc_id"]].assign(n_bytes=[len(r) for r in raw], media=[mux(r + bytes(-len(r) % UNIT if r else UNIT)) for r in raw])

    return with_nulls(keyed_texts(docs).mapInPandas(write, "has_id boolean, doc_id long, n_bytes long, media binary"))


PACKET = "track long, timestamp_ns long, duration_ns long, keyframe boolean, lacing int, cluster int, start long, length long, error string"


def _keyed(media: DataFrame, key: str) -> DataFrame:
    size = F.coalesce(F.col("n_bytes"), F.lit(-1)).cast("long").alias("n_bytes") if "n_bytes" in media.columns else F.lit(-1).cast("long").alias("n_bytes")
    return media.select(F.col(key).isNotNull().alias("has_id"), F.coalesce(F.col(key).cast("long"), F.lit(0)).alias("doc_id"), size, "media")


def packets(media: DataFrame, key: str = "doc_id") -> DataFrame:
    """The packet table of a media column: a whole-number key, packet, track, timestamps, flags, cluster, byte range."""

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for has, k, data in zip(b["has_id"].tolist(), b["doc_id"].tolist(), b["media"], strict=True):
                if data is None:
                    continue
                try:
                    rows += [(has, k, n, t, at, each, bool(f & 0x80), f >> 1 & 3, c, s, e - s, None) for n, (t, at, each, f, c, s, e) in enumerate(parse(bytes(data))["packets"])]
                except ValueError as fault:
                    rows.append((has, k, *[None] * 9, str(fault)))
            yield pd.DataFrame(rows, columns=["has_id", "doc_id", "packet", *[c.split()[0] for c in PACKET.split(", ")]]).astype({c: "Int64" for c in ("packet", "track", "timestamp_ns", "duration_ns", "lacing", "cluster", "start", "length")})

    found = _keyed(media, key).select("has_id", "doc_id", "media").mapInPandas(read, f"has_id boolean, doc_id long, packet int, {PACKET}")
    return with_nulls(found).withColumnRenamed("doc_id", key)


def features(media: DataFrame) -> DataFrame:
    """One row per stored file, from its parsed packets: the payload read back through the packets' byte ranges, its
    hashes, and a feature string (counts, time, cues that hit a cluster, sample mean, deviation, entropy)."""

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for has, doc_id, n, data in zip(b["has_id"].tolist(), b["doc_id"].tolist(), b["n_bytes"].tolist(), b["media"], strict=True):
                if data is None:
                    rows.append((has, doc_id, n, *[None] * 6))
                    continue
                data = bytes(data)
                try:
                    m = parse(data)
                except ValueError as fault:
                    rows.append((has, doc_id, n, None, None, None, len(data), hashlib.sha256(data).hexdigest(), f"error: {fault}"))
                    continue
                payload = b"".join([data[s:e] for *_, s, e in m["packets"]])
                share = np.bincount(np.frombuffer(payload, np.uint8), minlength=256) / max(1, len(payload))
                level = np.arange(256)
                mean = float(share @ level)
                some = share[share > 0]
                lacings = np.bincount([p[3] >> 1 & 3 for p in m["packets"]], minlength=4)
                text = f"tracks={len(m['tracks'])};clusters={len(m['clusters'])};packets={len(m['packets'])};lacing={','.join(map(str, lacings))};duration_ns={m['duration_ns']};cues={sum(c[3] for c in m['cues'])};mean={mean:.4f};dev={float(share @ (level - mean) ** 2) ** 0.5:.4f};entropy={float(-(some * np.log2(some)).sum()):.4f}"
                rows.append((has, doc_id, n, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-UNIT:]), len(data), hashlib.sha256(data).hexdigest(), text))
            yield pd.DataFrame(rows, columns=["has_id", "doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]).astype({c: "Int64" for c in ("payload_bytes", "tail_crc32", "media_bytes")})

    found = _keyed(media, "doc_id").mapInPandas(read, "has_id boolean, doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")
    return with_nulls(found).withColumn("n_bytes", F.when(F.col("n_bytes") >= 0, F.col("n_bytes")))


def op1_matroska(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Write the media table once, read the stored bytes back, compute the features."""
    return features(staged(media_column(table(spark, sf_dir, "documents")), "media"))
