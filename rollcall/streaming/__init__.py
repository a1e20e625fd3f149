from .rows import mark_stream

__all__ = ["mark_stream"]
