"""The library's intermediate tables."""

from strataform.scratch import clear, mark, release, written

__all__ = ["clear", "mark", "release", "written"]
