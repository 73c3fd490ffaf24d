from foliograph.sources.tables import latest_rows, load, present

__all__ = ["latest_rows", "load", "present"]
