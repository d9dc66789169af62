"""Modules: the same interface offered by many installed instances, read as one collection."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import functions as F

from ..plans.view import View


class ModuleSpace:
    """Installed instances by id, each with its interfaces as views."""

    def __init__(self):
        self.instances: dict[str, dict[str, View]] = {}

    def install(self, instance: str, interfaces: dict[str, View]) -> None:
        if instance in self.instances:
            raise ValueError(f"{instance} is installed already")
        self.instances[instance] = dict(interfaces)

    def update(self, instance: str, interfaces: dict[str, View]) -> None:
        self.instances[instance] |= interfaces

    def rename(self, old: str, new: str) -> None:
        if new in self.instances:
            raise ValueError(f"{new} is installed already")
        self.instances[new] = self.instances.pop(old)

    def uninstall(self, instance: str) -> None:
        del self.instances[instance]

    def read(self, instance: str, interface: str) -> View:
        return self.instances[instance][interface]

    def all(self, interface: str) -> View:
        """``modules::interface``: every instance's rows; the instance id comes first in the identity."""
        views = {i: v[interface].bounded() for i, v in sorted(self.instances.items()) if interface in v}
        if not views:
            raise KeyError(interface)
        frames = []
        for i, v in views.items():
            ids = {f"__id{k + 1}": F.col(c) for k, c in enumerate(v.id_columns)}
            frames.append(v.df.withColumns(ids).withColumns({"__id0": F.lit(i), "instance": F.lit(i)}).drop(*[f"__ord{k}" for k in range(len(v.down))]))
        first = next(iter(views.values()))
        return View(reduce(lambda a, b: a.unionByName(b), frames), first.ids + 1, (), f"modules::{interface}")
