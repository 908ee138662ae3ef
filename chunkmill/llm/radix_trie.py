"""A compressed radix (Patricia) trie over byte strings, with bounded memory.

A terminal node holds one payload, and equal keys merge their payloads. When the trie outgrows its
budget, its heaviest subtree moves to a temporary file; later keys below that point are appended to the
file, and each file is read into a trie of its own at the end. Files have no name and go with their handle.
"""

from __future__ import annotations

import pickle
import tempfile
from collections.abc import Callable, Iterator
from typing import Any

NODE_BYTES = 250


class Node:
    __slots__ = ("label", "children", "payload")

    def __init__(self, label: bytes, payload: Any = None):
        self.label, self.payload = label, payload
        self.children: dict[int, Node | Spilled] = {}


class Spilled:
    """A subtree on disk: its whole keys with their payloads."""

    __slots__ = ("file",)

    def __init__(self):
        self.file = tempfile.TemporaryFile(prefix="trie-")

    def append(self, key: bytes, payload: Any) -> None:
        pickle.dump((key, payload), self.file, protocol=5)

    def items(self) -> Iterator[tuple[bytes, Any]]:
        self.file.seek(0)
        while True:
            try:
                yield pickle.load(self.file)
            except EOFError:
                break
        self.file.close()


def shared_prefix(label: bytes, key: bytes, at: int) -> int:
    """How many leading bytes of ``label`` stand in ``key`` from ``at`` on."""
    low, high = 0, min(len(label), len(key) - at)
    while low < high:
        mid = (low + high + 1) // 2
        if label[low:mid] == key[at + low : at + mid]:
            low = mid
        else:
            high = mid - 1
    return low


class RadixTrie:
    def __init__(self, merge: Callable[[Any, Any], Any], memory_bytes: int):
        self.merge, self.memory_bytes = merge, memory_bytes
        self.root, self.bytes, self.spills = Node(b""), 0, 0
        self.next_spill = memory_bytes

    def insert(self, key: bytes, payload: Any) -> None:
        node, at, end = self.root, 0, len(key)
        while at < end:
            child = node.children.get(key[at])
            if child is None:
                node.children[key[at]] = Node(key[at:], payload)
                self.bytes += NODE_BYTES + end - at
                break
            if isinstance(child, Spilled):
                child.append(key, payload)
                return
            if not key.startswith(child.label, at):
                k = shared_prefix(child.label, key, at)
                middle = Node(child.label[:k])
                child.label = child.label[k:]
                middle.children[child.label[0]] = child
                node.children[key[at]] = child = middle
                self.bytes += NODE_BYTES
            node, at = child, at + len(child.label)
        else:
            node.payload = payload if node.payload is None else self.merge(node.payload, payload)
        if self.bytes > self.next_spill:
            self.spill()

    def spill(self) -> None:
        """Move subtrees of the first branching node to files, heaviest first, until half of the budget is free."""
        node, path = self.root, b""
        while node.payload is None and len(node.children) == 1 and isinstance(c := next(iter(node.children.values())), Node):
            node, path = c, path + c.label
        kept = {b: c for b, c in node.children.items() if isinstance(c, Node)}
        weights = {b: sum(NODE_BYTES + len(n.label) for _, n in walk(c, b"")) for b, c in kept.items()}
        for b in sorted(weights, key=weights.get, reverse=True):
            if self.bytes <= self.memory_bytes // 2:
                break
            out = Spilled()
            for key, n in walk(kept[b], path):
                if n.payload is not None:
                    out.append(key, n.payload)
                for k, below in n.children.items():  # already on disk: its file moves up a level
                    if isinstance(below, Spilled):
                        for x in below.items():
                            out.append(*x)
            node.children[b] = out
            self.bytes -= weights[b]
            self.spills += 1
        self.next_spill = max(self.memory_bytes, self.bytes + self.memory_bytes // 2)  # a single string can exceed it

    def items(self) -> Iterator[Any]:
        """All payloads; ends the trie's use."""
        later = []
        for _, n in walk(self.root, b"", keys=False):
            if n.payload is not None:
                yield n.payload
            later += [c for c in n.children.values() if isinstance(c, Spilled)]
        self.root = Node(b"")
        for spilled in later:
            below = RadixTrie(self.merge, self.memory_bytes)
            for key, payload in spilled.items():
                below.insert(key, payload)
            yield from below.items()


def walk(node: Node, path: bytes, keys: bool = True) -> Iterator[tuple[bytes, Node]]:
    """Each node in memory with its whole key (without ``keys``, an empty one)."""
    todo = [(path, node)]
    while todo:
        path, node = todo.pop()
        if keys:
            path = path + node.label
        yield path, node
        todo += [(path, c) for c in node.children.values() if isinstance(c, Node)]
