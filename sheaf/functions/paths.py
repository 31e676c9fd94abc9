"""Path rules as Column expressions: archive paths, object keys and local targets."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Where an archive keeps its checksum catalog; archives written elsewhere may use another path.
CATALOG_PATH = ".catalog/catalog.v1.json"


def trim_slashes(path: Column) -> Column:
    """Without trailing slashes."""
    return F.regexp_replace(path, r"/+$", "")


def is_directory(path: Column) -> Column:
    return path.endswith("/")


def path_error(path: Column) -> Column:
    """Why a raw archive path is refused; null where it is safe.  The first reason wins.

    Fixed values: the texts of the reasons, which reports show.
    """
    body = trim_slashes(path)
    return (
        F.when(path.isNull() | (path == ""), "empty path")
        .when(F.instr(path, "\0") > 0, "NUL byte in path")
        .when(path.startswith("/") | path.startswith("\\"), "absolute path")
        .when(F.instr(path, "\\") > 0, "backslash path separators are not supported")
        .when(body == "", "root directory entry")
        .when(_first_bad(body) == "empty", "empty path component")
        .when(_first_bad(body) == "relative", "relative path component")
        .when(body.rlike(r"^[A-Za-z]:(/|$)"), "Windows drive prefix")
    )


def _first_bad(body: Column) -> Column:
    """Kind of the leftmost component that is empty or a dot name (a drive counts only in front)."""
    found = F.regexp_extract(body, r"(?:^|/)(|\.|\.\.)(?=/|$)", 0)
    has = body.rlike(r"(^|/)(|\.|\.\.)(/|$)")
    drive = body.rlike(r"^[A-Za-z]:(/|$)")
    return F.when(has & ~drive, F.when(F.regexp_replace(found, "/", "") == "", "empty").otherwise("relative"))


def normalized_path(path: Column) -> Column:
    """The safe form (directories keep one trailing slash); null where the path is refused."""
    body = trim_slashes(path)
    return F.when(path_error(path).isNull(), F.when(is_directory(path), F.concat(body, F.lit("/"))).otherwise(body))


def join_key(prefix: Column, path: Column) -> Column:
    """Object key of an archive path under a prefix."""
    return F.when(prefix == "", path).when(prefix.endswith("/"), F.concat(prefix, path)).otherwise(F.concat(prefix, F.lit("/"), path))


def list_prefix(prefix: Column) -> Column:
    """A listing prefix ends in a slash unless it is empty."""
    return F.when((prefix == "") | prefix.endswith("/"), prefix).otherwise(F.concat(prefix, F.lit("/")))


def key_to_path(prefix: Column, key: Column) -> Column:
    """Path of a key relative to its listing prefix; null where the key lies outside."""
    head = list_prefix(prefix)
    return F.when(head == "", key).when(key.startswith(head), F.substring(key, F.length(head) + 1, F.length(key)))


def key_entry_error(prefix: Column, key: Column, size: Column) -> Column:
    """Why an object cannot become an archive entry (a zero-byte root marker is silently left out)."""
    path = key_to_path(prefix, key)
    return (
        F.when(path.isNull(), "key is outside the source prefix")
        .when((path == "") & (size != 0), "source prefix root object cannot be an archive entry")
        .when(path == "", F.lit(None))
        .when(path_error(path).isNotNull(), path_error(path))
        .when(is_directory(path) & (size != 0), "trailing-slash objects must be zero-byte directory markers")
    )


def object_uri(uri: Column) -> dict[str, Column]:
    """bucket, key, prefix and the error of an object URI (``s3://bucket/key``)."""
    rest = F.when(uri.startswith("s3://"), F.substring(uri, F.lit(6), F.length(uri)))
    bucket = F.regexp_extract(rest, r"^([^/]*)", 1)
    key = F.regexp_extract(rest, r"^[^/]*/((?s:.*))$", 1)
    error = F.when(rest.isNull(), "missing s3:// scheme").when(bucket == "", "missing bucket").when(key == "", "missing object key")
    return {"bucket": bucket, "key": key, "prefix": F.regexp_replace(key, r"^/+", ""), "error": error}


#: Names that Windows keeps for devices.
DEVICES = r"(CON|PRN|AUX|NUL|CONIN\$|CONOUT\$|COM[1-9]|LPT[1-9])"


def unsafe_local_path(path: Column) -> Column:
    """True where a component cannot be a local file name on every system."""
    body = trim_slashes(path)
    return (
        body.rlike(r'[<>:"|?*]')
        | body.rlike("[\\x00-\\x1F\\x7F-\\x9F]")
        | body.rlike(r"[ .](/|$)")
        | body.rlike(rf"(?i)(^|/){DEVICES}[ .]*(\.[^/]*)?(/|$)")
    )


def local_target(root: str, path: Column) -> Column:
    return F.concat_ws("/", F.lit(root.rstrip("/")), trim_slashes(path))


def collision_key(path: Column, ignore_case: bool) -> Column:
    body = trim_slashes(path)
    return F.lower(body) if ignore_case else body


def ancestors(path: Column) -> Column:
    """All proper parents of a path, as an array."""
    parts = F.split(trim_slashes(path), "/")
    count = F.size(parts)
    return F.when(count > 1, F.transform(F.sequence(F.lit(1), count - 1), lambda i: F.array_join(F.slice(parts, 1, i), "/"))).otherwise(F.array().cast("array<string>"))


def swap_case(name: Column) -> Column:
    """ASCII letters with their case swapped, to probe case-insensitive file systems."""
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    return F.translate(name, upper + lower, lower + upper)


def safe_manifest_path(path: Column) -> Column:
    """True for a relative path that stays inside its folder."""
    return path.isNotNull() & (path != "") & ~path.rlike(r"^/|\\|(^|/)(|\.|\.\.)(/|$)|^[A-Za-z]:")
