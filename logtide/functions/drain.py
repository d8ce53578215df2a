"""Log template mining after He et al., "Drain" (ICWS 2017): a fixed-depth tree of token groups."""

from __future__ import annotations

import re
from collections import OrderedDict
from dataclasses import dataclass, field

from ..operators.stream import MASKS

WILD = "<*>"
_MASKS = [(re.compile(p), m) for p, m in MASKS]


def mask_text(message: str) -> str:
    for pattern, mark in _MASKS:
        message = pattern.sub(mark, message)
    return message


@dataclass
class Cluster:
    cluster_id: int
    tokens: list[str]
    size: int = 1

    @property
    def template(self) -> str:
        return " ".join(self.tokens)


@dataclass
class Drain:
    """Online miner. ``add`` learns a line; ``match`` only looks one up.

    ``sim_th``: least share of equal tokens. ``depth``: levels of the tree, the
    token count and the leaves included. ``max_clusters``: the least recently
    used cluster goes beyond that many.
    """

    sim_th: float = 0.4
    depth: int = 4
    max_children: int = 100
    max_clusters: int = 1024
    clusters: OrderedDict = field(default_factory=OrderedDict)
    leaves: dict = field(default_factory=dict)
    children: dict = field(default_factory=dict)
    last_id: int = 0

    @staticmethod
    def tokens(message: str) -> list[str]:
        return mask_text(message.strip()).replace("_", " ").split()

    def _leaf(self, tokens: list[str], grow: bool) -> tuple | None:
        path: tuple = (len(tokens),)
        for token in tokens[: max(0, self.depth - 2)]:
            known = self.children.setdefault(path, set()) if grow else self.children.get(path, ())
            step = token if token in known else WILD
            if grow and step is WILD and token not in known:
                if not any(c.isdigit() for c in token) and len(known) < self.max_children - (WILD not in known):
                    step = token
                known.add(step)
            elif not grow and step not in known:
                return None
            path += (step,)
        return path

    def _best(self, ids, tokens: list[str], least: float, wild: bool) -> Cluster | None:
        best, top = None, (-1.0, -1)
        for i in ids:
            c = self.clusters.get(i)
            if c is None or len(c.tokens) != len(tokens):
                continue
            free = sum(t == WILD for t in c.tokens)
            same = sum(a == b and a != WILD for a, b in zip(c.tokens, tokens, strict=True)) + (free if wild else 0)
            rank = (same / len(tokens) if tokens else 1.0, free)
            if rank > top:
                best, top = c, rank
        return best if best is not None and top[0] >= least else None

    def match(self, message: str, full_search: bool = False) -> Cluster | None:
        """The cluster whose template the line fits exactly, by the tree, then (``full_search``) among all."""
        tokens = self.tokens(message)
        path = self._leaf(tokens, False)
        found = self._best(self.leaves.get(path, ()), tokens, 1.0, True) if path else None
        return found or (self._best(self.clusters, tokens, 1.0, True) if full_search else None)

    def add(self, message: str) -> tuple[Cluster, str]:
        """(cluster, change): cluster_created, cluster_template_changed or none."""
        tokens = self.tokens(message)
        leaf = self.leaves.setdefault(self._leaf(tokens, True), [])
        cluster = self._best(leaf, tokens, self.sim_th, False)
        if cluster is None:
            self.last_id += 1
            cluster = self.clusters[self.last_id] = Cluster(self.last_id, tokens)
            leaf.append(self.last_id)
            while len(self.clusters) > self.max_clusters:
                self.clusters.popitem(last=False)
            return cluster, "cluster_created"
        merged = [a if a == b else WILD for a, b in zip(cluster.tokens, tokens, strict=True)]
        change = "none" if merged == cluster.tokens else "cluster_template_changed"
        cluster.tokens, cluster.size = merged, cluster.size + 1
        self.clusters.move_to_end(cluster.cluster_id)
        return cluster, change
