"""The store: generations of sorted Parquet behind a versioned manifest."""

from .manifest import CommitConflict, Generation, Manifest, Snapshot
from .store import Store, StoreConfig, open_store

__all__ = ["CommitConflict", "Generation", "Manifest", "Snapshot", "Store", "StoreConfig", "open_store"]
