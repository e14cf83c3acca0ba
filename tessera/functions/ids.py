"""Deterministic ids and hashes as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed value: the DNS namespace of version 5 UUIDs.
DNS = "6ba7b8109dad11d180b400c04fd430c8"


def uuid5(name: Column, namespace: str = DNS) -> Column:
    """Version 5 UUID of ``name`` in a namespace, from SHA-1."""
    h = F.sha1(F.concat(F.unhex(F.lit(namespace)), F.encode(name, "UTF-8")))
    variant = F.substring(F.lit("89ab"), (F.conv(F.substring(h, 17, 1), 16, 10).cast("int") % 4 + 1), F.lit(1))
    return F.concat_ws(
        "-", F.substring(h, 1, 8), F.substring(h, 9, 4), F.concat(F.lit("5"), F.substring(h, 14, 3)), F.concat(variant, F.substring(h, 18, 3)), F.substring(h, 21, 12)
    )


def chunk_id(repo: Column, file: Column, name: Column, line: Column) -> Column:
    return uuid5(F.concat_ws(":", repo, file, name, line.cast("string")))


def content_hash(source: Column) -> Column:
    return F.md5(source)


def cache_key(repo: Column, question: Column, top_k: Column) -> Column:
    """The key under which an answer is cached."""
    return F.concat(F.lit("qcache:"), F.md5(F.concat_ws(":", F.lit("q"), repo, question, top_k.cast("string"))))


def embedding_key(text: Column) -> Column:
    return F.concat(F.lit("emb:"), F.md5(text))
