"""Entity tags and content digests."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

EMPTY_MD5 = "d41d8cd98f00b204e9800998ecf8427e"


def normalize_etag(etag: Column) -> Column:
    """The MD5 that an entity tag holds, in lower case; null for multipart and other tags."""
    bare = F.lower(F.regexp_replace(F.regexp_replace(etag, r"^\s+|\s+$", ""), r'^"+|"+$', ""))
    return F.when(bare.rlike("^[0-9a-f]{32}$"), bare)


def comparable_md5(entry_size: Column, listed_size: Column, etag: Column) -> Column:
    """MD5 of a listed object if its content can equal an entry's: no listed size, or the same."""
    return F.when(F.coalesce(listed_size == entry_size, F.lit(True)), normalize_etag(etag))


def content_digest(content: Column) -> dict[str, Column]:
    return {"bytes": F.octet_length(content).cast("long"), "md5": F.md5(content), "crc32": F.crc32(content)}


def content_error(content: Column, size: Column, crc32: Column) -> Column:
    """Why read content differs from what its archive declares; null where it agrees."""
    n = F.octet_length(content)
    return F.when(n > size, "entry produced more bytes than declared").when(n < size, "entry produced fewer bytes than declared").when(F.crc32(content) != crc32, "CRC32 mismatch")
