"""Hierarchies of cubes: a cube for each path, parents' coordinates inherited."""

from __future__ import annotations

import fnmatch
from collections.abc import Callable, Iterator, Mapping
from dataclasses import dataclass, field
from functools import partial

from cubeweave.cube import AlignmentError, Cube
from cubeweave.operators import align as A
from cubeweave.operators.reduce import reduce


@dataclass(frozen=True)
class CubeTree:
    """``{path: cube}``, paths from ``/``; groups without a cube hold None."""

    nodes: Mapping[str, Cube | None] = field(default_factory=dict)

    @classmethod
    def from_dict(cls, nodes: Mapping[str, Cube | None], check: bool = False) -> CubeTree:
        """With ``check``, one small job for each dimension that a child shares with its parent: labels have to agree."""
        full: dict[str, Cube | None] = {}
        for path, cube in nodes.items():
            parts = [p for p in path.split("/") if p]
            for k in range(len(parts)):
                full.setdefault("/" + "/".join(parts[:k]), None)
            full["/" + "/".join(parts)] = cube
        tree = cls(dict(sorted(full.items())))
        if check:
            for path, cube in tree.nodes.items():
                above = tree.nodes.get(tree.parent(path)) if path != "/" else None
                if cube is not None and above is not None:
                    for d in set(cube.dims) & set(above.dims):
                        if A.fingerprint(cube, d) != A.fingerprint(above, d):
                            raise AlignmentError(f"{path} doesn't align with its parent along {d}")
        return tree

    def to_dict(self) -> dict[str, Cube | None]:
        return dict(self.nodes)

    @staticmethod
    def parent(path: str) -> str:
        return path.rsplit("/", 1)[0] or "/"

    def __getitem__(self, path: str) -> Cube | None:
        return self.nodes["/" + path.strip("/")]

    def set(self, path: str, cube: Cube) -> CubeTree:
        return CubeTree.from_dict({**self.nodes, path: cube})

    def children(self, path: str = "/") -> list[str]:
        return [p for p in self.nodes if p != path and self.parent(p) == path]

    def subtree(self, path: str) -> CubeTree:
        root = "/" + path.strip("/")
        return CubeTree.from_dict({p[len(root.rstrip("/")) :] or "/": c for p, c in self.nodes.items() if p == root or p.startswith(root.rstrip("/") + "/")})

    def __iter__(self) -> Iterator[tuple[str, Cube | None]]:
        """Breadth first."""
        return iter(sorted(self.nodes.items(), key=lambda kv: (kv[0].count("/") if kv[0] != "/" else 0, kv[0])))

    @property
    def depth(self) -> int:
        return max((p.count("/") for p in self.nodes if p != "/"), default=0)

    @property
    def leaves(self) -> list[str]:
        return [p for p in self.nodes if not self.children(p)]

    def isomorphic(self, other: CubeTree) -> bool:
        return set(self.nodes) == set(other.nodes)

    def map(self, func: Callable[..., Cube | None], *others: CubeTree) -> CubeTree:
        """``func`` at each node that has a cube in all trees; plans stay lazy."""
        if not all(self.isomorphic(o) for o in others):
            raise ValueError("trees differ in shape")
        return CubeTree({p: None if c is None or any(o.nodes[p] is None for o in others) else func(c, *[o.nodes[p] for o in others]) for p, c in self.nodes.items()})

    def filter(self, keep: Callable[[str, Cube | None], bool]) -> CubeTree:
        return CubeTree.from_dict({p: c for p, c in self.nodes.items() if keep(p, c)})

    def filter_like(self, other: CubeTree) -> CubeTree:
        return self.filter(lambda p, c: p in other.nodes)

    def match(self, pattern: str) -> CubeTree:
        """Paths that fit a glob."""
        return self.filter(lambda p, c: fnmatch.fnmatch(p.lstrip("/"), pattern))

    def prune(self) -> CubeTree:
        return self.filter(lambda p, c: c is not None and bool(c.names))

    def reduce(self, name: str, dims: str | list[str] | None = None) -> CubeTree:
        def one(c: Cube) -> Cube:
            own = [d for d in ([dims] if isinstance(dims, str) else dims or c.dims) if d in c.dims]
            return reduce(c, name, own)

        return self.map(one)

    def binary(self, other: CubeTree, op: Callable) -> CubeTree:
        return self.map(partial(A.binary, op=op), other)

    def merge(self, other: CubeTree) -> CubeTree:
        paths = dict.fromkeys([*self.nodes, *other.nodes])

        def one(p: str) -> Cube | None:
            a, b = self.nodes.get(p), other.nodes.get(p)
            return A.merge(a, b) if a is not None and b is not None else a if a is not None else b

        return CubeTree.from_dict({p: one(p) for p in paths})

    def concat(self, other: CubeTree, dim: str) -> CubeTree:
        return self.map(lambda a, b: A.concat([a, b], dim), other)

    def equals(self, other: CubeTree) -> bool:
        return self.isomorphic(other) and all((c is None) == (other.nodes[p] is None) and (c is None or c.equals(other.nodes[p])) for p, c in self.nodes.items())
