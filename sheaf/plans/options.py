"""Options of the operations, checked when they are made."""

from __future__ import annotations

from dataclasses import dataclass, field

from sheaf.functions import tuning
from sheaf.functions.paths import CATALOG_PATH
from sheaf.functions.tuning import RetryPolicy
from sheaf.operators.selection import Selection


@dataclass(frozen=True)
class SyncOptions:
    """How an archive is synchronised to a destination.

    ``profile`` names the rules of the archive's side: ``object_zip`` or ``local_zip`` (they
    differ in when the catalog decides, and in what a missing tag means).
    """

    prefix: str = ""
    profile: str = "object_zip"
    use_catalog: bool = True
    delete_extra: bool = False
    fail_fast: bool = False
    dry_run: bool = False
    collect_operations: bool = True
    selection: Selection = field(default_factory=Selection)
    catalog_path: str = CATALOG_PATH
    concurrency: int = tuning.ENTRY_CONCURRENCY
    put_concurrency: int = tuning.PUT_CONCURRENCY
    get_concurrency: int = tuning.GET_CONCURRENCY
    block_size: int = tuning.BLOCK_SIZE
    merge_gap: int = tuning.MERGE_GAP
    window_size: int = tuning.WINDOW_SIZE
    retry: RetryPolicy = RetryPolicy()

    def __post_init__(self):
        if self.profile not in ("object_zip", "local_zip"):
            raise ValueError("profile must be object_zip or local_zip")
        for name in ("concurrency", "put_concurrency", "get_concurrency", "block_size", "window_size"):
            if getattr(self, name) < 1:
                raise ValueError(f"{name} must be at least 1")
        if self.merge_gap < 0:
            raise ValueError("merge_gap must not be negative")
        if self.delete_extra and not self.prefix.strip("/"):
            raise ValueError("delete_extra needs a destination prefix")
        if self.delete_extra and self.selection.compiled():
            raise ValueError("delete_extra cannot be combined with a selection")


@dataclass(frozen=True)
class PackOptions:
    """How a tree is packed into an archive."""

    include_catalog: bool = True
    compression: str = "deflate"
    catalog_path: str = CATALOG_PATH
    part_size: int = tuning.PART_SIZE
    collect_operations: bool = True

    def __post_init__(self):
        if self.compression not in ("stored", "deflate", "zstd"):
            raise ValueError("compression must be stored, deflate or zstd")
        if self.part_size < 1:
            raise ValueError("part_size must be at least 1")


def check_not_nested(source: str, destination: str, what: str) -> None:
    """An archive may not be written inside the tree it is made of."""
    head = source.rstrip("/") + "/"
    if destination == source or destination.startswith(head):
        raise ValueError(f"{what} destination lies inside its source")
