"""Materialising intermediate results where every executor can read them."""

from lodestone.storage import checkpointed as materialise
from lodestone.storage import drop_path, release, shared_path

__all__ = ["drop_path", "materialise", "release", "shared_path"]
