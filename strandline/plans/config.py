"""Pipelines declared as data: nodes that call functions on the outputs of other nodes.

A node is ``{func: "module:name" or callable, output: name, inputs: {argument: node or input}, bound: {...}}``.
All recordings go through a node together, told apart by ``input_id``, so there is no map over recordings
and the whole graph is one lazy plan; its one leaf is the sample table.
"""

from __future__ import annotations

import hashlib
import importlib
import json
from collections.abc import Callable, Mapping
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import DataFrame

from ..session import exists


def resolve(name: str | Callable) -> Callable:
    if callable(name):
        return name
    module, _, attribute = name.partition(":")
    out = importlib.import_module(module)
    for part in attribute.split("."):
        out = getattr(out, part)
    return out


def checked(node: Mapping[str, Any]) -> Mapping[str, Any]:
    """The declaration of a node, if it is one."""
    kinds = {"func": (str, Callable), "output": str, "inputs": Mapping, "bound": Mapping}
    missing, unknown = {"func", "output"} - node.keys(), node.keys() - kinds.keys()
    if missing or unknown:
        raise ValueError(f"a node lacks {sorted(missing)} or has no place for {sorted(unknown)}")
    wrong = [k for k, v in node.items() if not isinstance(v, kinds[k])]
    if wrong:
        raise TypeError(f"of a wrong kind in a node: {wrong}")
    if isinstance(node["func"], str) and ":" not in node["func"]:
        raise ValueError(f"a function is named module:name, not {node['func']!r}")
    return node


@dataclass(frozen=True)
class Node:
    func: str | Callable
    output: str
    inputs: Mapping[str, Any] = field(default_factory=dict)
    bound: Mapping[str, Any] = field(default_factory=dict)


class Pipeline:
    def __init__(self, nodes: list[Node | Mapping[str, Any]]):
        self.nodes = [n if isinstance(n, Node) else Node(**checked(n)) for n in nodes]
        names = [n.output for n in self.nodes]
        if len(set(names)) != len(names):
            raise ValueError("two nodes have one output")
        used = {v for n in self.nodes for v in names_in(n.inputs)}
        self.leaves = [n for n in names if n not in used]

    @classmethod
    def from_yaml(cls, text: str) -> Pipeline:
        import yaml

        return cls(yaml.safe_load(text)["nodes"])

    @property
    def leaf(self) -> str:
        if len(self.leaves) != 1:
            raise ValueError(f"the pipeline has {len(self.leaves)} leaves: {self.leaves}")
        return self.leaves[0]

    def order(self, given: set[str]) -> list[Node]:
        """Nodes after those that they use."""
        waiting, known, out = list(self.nodes), set(given), []
        while waiting:
            ready = [n for n in waiting if names_in(n.inputs) <= known]
            if not ready:
                raise ValueError(f"inputs are missing or go in a circle: {sorted(set().union(*(names_in(n.inputs) for n in waiting)) - known)}")
            out += ready
            known |= {n.output for n in ready}
            waiting = [n for n in waiting if n not in ready]
        return out

    def run(self, run_folder: str | None = None, return_results: bool = True, **given: Any) -> DataFrame | None:
        """The leaf's DataFrame; nothing is computed yet. With a run folder the leaf is written there as Parquet
        and read from it; without results wanted, which needs a run folder, None is returned."""
        if not return_results and run_folder is None:
            raise ValueError("results that aren't returned need a run folder")
        leaf, values = self.leaf, dict(given)
        unused = set(given) - {v for n in self.nodes for v in names_in(n.inputs)}
        if unused:
            raise ValueError(f"no node uses these inputs: {sorted(unused)}")
        for node in self.order(set(given)):
            values[node.output] = resolve(node.func)(**{k: filled(v, values) for k, v in node.inputs.items()}, **node.bound)
        out = values[leaf]
        if run_folder is None:
            return out
        path = f"{run_folder}/{leaf}"
        out.write.mode("overwrite").parquet(path)
        return out.sparkSession.read.parquet(path) if return_results else None

    def digest(self) -> str:
        """A key for caches: equal declarations have equal ones."""
        text = json.dumps([[str(n.func), n.output, n.inputs, n.bound] for n in self.nodes], sort_keys=True, default=str)
        return hashlib.blake2b(text.encode(), digest_size=8).hexdigest()

    def cached(self, folder: str, **given: Any) -> DataFrame:
        """The leaf from Parquet below ``folder`` if this pipeline has written it from these inputs, else computed
        and written. Tables count as the same by their schema and files, or by their plan if they have none."""
        spark = next(v.sparkSession for v in given.values() if isinstance(v, DataFrame))
        about = {k: [v.schema.json(), sorted(v.inputFiles()) or v.semanticHash()] if isinstance(v, DataFrame) else repr(v) for k, v in sorted(given.items())}
        path = f"{folder}/{self.digest()}-{hashlib.blake2b(json.dumps(about).encode(), digest_size=8).hexdigest()}"
        if not exists(spark, f"{path}/_SUCCESS"):
            self.run(**given).write.mode("overwrite").parquet(path)
        return spark.read.parquet(path)


def names_in(value: Any) -> set[str]:
    """Names of nodes and inputs in an argument: texts, also within lists and mappings."""
    if isinstance(value, str):
        return {value}
    if isinstance(value, Mapping):
        return set().union(*map(names_in, value.values()), set())
    if isinstance(value, (list, tuple)):
        return set().union(*map(names_in, value), set())
    return set()


def filled(value: Any, values: Mapping[str, Any]) -> Any:
    if isinstance(value, str):
        return values[value]
    if isinstance(value, Mapping):
        return {k: filled(v, values) for k, v in value.items()}
    if isinstance(value, (list, tuple)):
        return [filled(v, values) for v in value]
    return value
