"""Operator 3: media columns in Matroska.

``to_matroska`` stores byte payloads as 8-bit PCM in a binary column;
``packet_table`` parses such a column into one row per packet (track, timestamp,
byte range, cluster, lacing); ``features`` reads the payload back from the
packets' byte ranges and describes it.

Defined results: null text is an empty payload (64 zero bytes); equal texts give
equal bytes; a null media value has no packets and null features; malformed
bytes give one row with null results and the reason in ``error`` (null elsewhere);
an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import zlib

import numpy as np
from pyspark.sql import DataFrame

from lexiloom.llm import ebml
from lexiloom.llm.common import map_batches, spread, table

UNIT = 64


def padded(text: str | None) -> tuple[bytes, int]:
    """UTF-8 bytes with zeros up to a positive multiple of 64, and the bytes before that."""
    raw = (text or "").encode("utf-8")
    return raw + bytes(max(UNIT, -(-len(raw) // UNIT) * UNIT) - len(raw)), len(raw)


def to_matroska(docs: DataFrame) -> DataFrame:
    """Per row: doc_id, n_bytes, media."""

    def body(cols):
        made = [padded(t) for t in cols["text"].to_pylist()]
        return {"doc_id": cols["doc_id"], "n_bytes": [n for _, n in made], "media": [ebml.write(p) for p, _ in made]}

    rows = docs.selectExpr("CAST(doc_id AS BIGINT) AS doc_id", "CAST(text AS STRING) AS text")
    return map_batches(rows, body, "doc_id long, n_bytes long, media binary")


def packet_table(media: DataFrame) -> DataFrame:
    """One row per packet of each media value; one row without a packet, but with its ``error``, for malformed bytes."""
    names = ["packet", "track", "timestamp_ns", "offset", "size", "cluster", "keyframe", "lacing"]

    def body(cols):
        out = {n: [] for n in ["doc_id", *names, "error"]}
        for doc, data in zip(cols["doc_id"].to_pylist(), cols["media"].to_pylist()):
            try:
                packets, error = ebml.parse(data).packets if data is not None else [], None
            except ebml.Malformed as e:
                packets, error = [], str(e)
            rows = [(doc, i, p.track, p.timestamp_ns, p.offset, p.size, p.cluster, p.keyframe, p.lacing, None) for i, p in enumerate(packets)]
            for row in rows if error is None else [(doc, *[None] * len(names), error)]:
                for n, v in zip(out, row):
                    out[n].append(v)
        return out

    return map_batches(media.select("doc_id", "media"), body, "doc_id long, packet int, track long, timestamp_ns long, offset long, size long, cluster long, keyframe boolean, lacing int, error string")


def describe(data: bytes) -> tuple[bytes, str]:
    """The stored samples, and what packets and samples say as a string."""
    movie = ebml.parse(data)
    if sorted({c for _, _, c in movie.cues}) != sorted(movie.clusters):
        raise ebml.Malformed("cues do not point at the clusters")
    payload = ebml.samples(data, movie)
    x = np.frombuffer(payload, np.uint8).astype(np.int64)
    level = x - 128
    codec = ",".join(t["codec"] for _, t in sorted(movie.tracks.items()))
    parts = {
        "codec": codec, "clusters": len(movie.clusters), "packets": len(movie.packets),
        "laced": sum(1 for p in movie.packets if p.lacing), "last_ms": max((p.timestamp_ns for p in movie.packets), default=0) // 1_000_000,
        "samples": len(x), "sum": int(x.sum()), "energy": int((level * level).sum()), "peak": int(x.max(initial=0)),
        "crossings": int(np.count_nonzero((level[1:] < 0) != (level[:-1] < 0))),
    }
    return payload, ";".join(f"{k}={v}" for k, v in parts.items())


def features(media: DataFrame) -> DataFrame:
    """Per media value: digests of stored form and payload, the feature string, and the error of malformed bytes."""

    def body(cols):
        out = {n: [] for n in ("payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "error")}
        for data in cols["media"].to_pylist():
            if data is None:
                row = [None] * 7
            else:
                stored = [len(data), hashlib.sha256(data).hexdigest()]
                try:
                    payload, feature = describe(data)
                    row = [len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-UNIT:]), *stored, feature, None]
                except ebml.Malformed as e:
                    row = [None, None, None, *stored, None, str(e)]
            for n, v in zip(out, row):
                out[n].append(v)
        return {"doc_id": cols["doc_id"], "n_bytes": cols["n_bytes"]} | out

    return map_batches(media, body, "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, error string")


def query(spark, sf_dir: str) -> DataFrame:
    return features(to_matroska(spread(table(spark, sf_dir, "documents"))))
