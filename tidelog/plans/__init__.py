"""How given tables become change logs."""

from .fixtures import conversations_log, events_log, lineitem_log, orders_log

__all__ = ["conversations_log", "events_log", "lineitem_log", "orders_log"]
