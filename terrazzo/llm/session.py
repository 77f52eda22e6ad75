"""The shared folder for checkpoints and payload shards."""

from ..sources.session import prepared, shared_folder

__all__ = ["prepared", "shared_folder"]
