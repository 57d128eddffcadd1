"""Tables between stages, in the folder that all executors share."""

from kgcube.sources.tables import delete, exists, new_folder, shared_folder, stored  # noqa: F401
