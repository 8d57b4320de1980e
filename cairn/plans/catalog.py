"""A catalog with its layers as methods; every method is lazy and returns a new catalog."""

from __future__ import annotations

from pyspark.sql import DataFrame

from cairn.operators import layers, overlays, unions, versions


class Catalog:
    """Rows of the member table and the requests that can be made of them.

    The usual order of layers is scan, ``transform``, ``automount``, ``union``,
    ``mount_under``, then an overlay on top.
    """

    def __init__(self, files: DataFrame):
        self.files = files

    # layers
    def transform(self, pattern: str, replacement: str) -> Catalog:
        return Catalog(layers.transform_paths(self.files, pattern, replacement))

    def automount(self, open_archives, **options) -> Catalog:
        return Catalog(layers.automount(self.files, open_archives, **options))

    def union(self, *others: Catalog) -> Catalog:
        """Merged listing of this catalog and later ones: one row, the newest of its source, per member."""
        sources = [versions.latest(c.files) for c in (self, *others)]
        return Catalog(unions.union_list(unions.union_sources(*sources)).drop("source_idx"))

    def mount_under(self, prefix: str) -> Catalog:
        return Catalog(layers.synthesize_parents(layers.mount_under(self.files, prefix)))

    def with_parents(self) -> Catalog:
        return Catalog(layers.synthesize_parents(self.files))

    def overlay(self, changes: DataFrame) -> Catalog:
        return Catalog(overlays.apply_overlay(versions.visible(self.files), changes))

    # requests
    def list(self, path: str) -> DataFrame:
        return versions.visible(self.files.where(self.files["path"] == path))

    def lookup(self, requests: DataFrame) -> DataFrame:
        return versions.lookup(self.files, requests)

    def version(self, n: int) -> DataFrame:
        return versions.nth_version(self.files, n)

    def version_paths(self) -> DataFrame:
        return versions.version_paths(self.files)

    def exists(self, requests: DataFrame) -> DataFrame:
        return versions.exists(versions.visible(self.files), requests)

    def page(self, path: str, **options) -> DataFrame:
        return versions.page(self.files, path, **options)
