"""Column functions: unsigned series ids and sizes in bytes."""

from .keys import from_unsigned, to_unsigned
from .sizes import memtable_size, table_size, wal_size

__all__ = ["from_unsigned", "memtable_size", "table_size", "to_unsigned", "wal_size"]
