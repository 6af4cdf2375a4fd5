"""The graph of relations that a query may join, and the order in which it does."""

from __future__ import annotations

from collections import defaultdict, deque
from collections.abc import Callable, Iterable
from dataclasses import dataclass, replace

from quillon.errors import JoinPathError


@dataclass(frozen=True)
class Edge:
    """From a relation to one that can be joined to it.  condition: a function of a function (alias, column) to Column."""

    start: str
    end: str
    condition: Callable
    how: str = "left"
    columns: tuple[tuple[str, str], ...] = ()  # (alias, column) that the condition needs
    first: tuple[str, ...] = ()  # relations that have to be there before


class JoinGraph:
    """Edges from a root.  The first edge of a pair wins; paths are the shortest, found once."""

    def __init__(self, root: str):
        self.root = root
        self.edges: dict[tuple[str, str], Edge] = {}
        self.after: dict[str, list[str]] = defaultdict(list)
        self._paths: dict[str, list[Edge]] = {}

    def add(self, edge: Edge) -> JoinGraph:
        if (edge.start, edge.end) not in self.edges:
            self.edges[edge.start, edge.end] = edge
            self.after[edge.start].append(edge.end)
            self._paths.clear()
        return self

    def copy(self) -> JoinGraph:
        return JoinGraph(self.root).merge(self)

    def merge(self, other: JoinGraph) -> JoinGraph:
        for e in other.edges.values():
            self.add(e)
        return self

    def path(self, end: str) -> list[Edge]:
        """Edges of the shortest way from the root."""
        if end not in self._paths:
            came: dict[str, Edge | None] = {self.root: None}
            queue = deque([self.root])
            while queue and end not in came:
                at = queue.popleft()
                for to in self.after.get(at, ()):
                    if to not in came:
                        came[to] = self.edges[at, to]
                        queue.append(to)
            if end not in came:
                raise JoinPathError(f"no way from {self.root} to {end}")
            back, at = [], end
            while (edge := came[at]) is not None:
                back.append(edge)
                at = edge.start
            self._paths[end] = back[::-1]
        return self._paths[end]

    def ordered(self, needed: Iterable[str], how: dict[str, str] | None = None) -> list[Edge]:
        """Edges to all needed relations, each after what it needs and none twice.  how: join types by relation that
        replace the edges' own."""
        chosen: dict[str, Edge] = {}

        def want(end: str, open_: tuple[str, ...] = ()) -> None:
            if end in open_:
                raise JoinPathError(f"{' -> '.join((*open_, end))} is a cycle")
            for e in self.path(end):
                if e.end in chosen:
                    continue
                for before in e.first:
                    if before != self.root:
                        want(before, (*open_, end))
                chosen[e.end] = replace(e, how=(how or {}).get(e.end, e.how))

        for end in needed:
            if end != self.root:
                want(end)
        return self._sorted(list(chosen.values()))

    def _sorted(self, edges: list[Edge]) -> list[Edge]:
        """Kahn's order, stable."""
        there, out, left = {self.root}, [], edges
        while left:
            ready = [e for e in left if e.start in there and all(x in there for x in e.first)]
            if not ready:
                raise JoinPathError("the joins form a cycle")
            out.append(ready[0])
            there.add(ready[0].end)
            left = [e for e in left if e is not ready[0]]
        return out

    def check_acyclic(self) -> None:
        """Raises if edges lead back to a relation that they came from."""
        state: dict[str, int] = {}

        def visit(at: str) -> None:
            state[at] = 1
            for to in self.after.get(at, ()):
                if state.get(to) == 1:
                    raise JoinPathError(f"{at} -> {to} closes a cycle")
                if to not in state:
                    visit(to)
            state[at] = 2

        for at in list(self.after):
            if at not in state:
                visit(at)
