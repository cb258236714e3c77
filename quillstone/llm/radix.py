"""A Patricia trie over byte strings that spills whole subtrees to disk."""

from __future__ import annotations

import os
import struct
import tempfile
from collections.abc import Callable, Iterator

_HEAD = struct.Struct("<Iqq")
#: What a node costs besides its label's bytes, roughly.
NODE_BYTES = 300


class _Node:
    """An edge's bytes, and the nodes or the owner below it."""

    __slots__ = ("children", "count", "label", "owner", "spilled", "weight")

    def __init__(self, label: bytes):
        self.label = label
        self.children: dict[int, _Node] = {}
        self.owner: int | None = None
        self.count = 0
        self.weight = 0  # bytes held in the subtree
        self.spilled: _Spill | None = None


class _Spill:
    """Strings of one subtree in a local file, without the path above it."""

    def __init__(self) -> None:
        self.file = tempfile.TemporaryFile(prefix="quillstone-trie-")

    def add(self, rest: bytes, owner: int, count: int) -> None:
        self.file.write(_HEAD.pack(len(rest), owner, count))
        self.file.write(rest)

    def read(self) -> Iterator[tuple[bytes, int, int]]:
        self.file.seek(0, os.SEEK_SET)
        while head := self.file.read(_HEAD.size):
            n, owner, count = _HEAD.unpack(head)
            yield self.file.read(n), owner, count
        self.file.close()


class OwnerTrie:
    """Byte strings with the owner that ``choose`` keeps and a count.

    Above ``budget`` bytes, the heaviest branch goes to a file, and later strings
    that reach it are appended there; ``items`` then inserts each file into a
    trie of its own. The result doesn't depend on what was spilled.
    """

    def __init__(self, choose: Callable[[int, int], int] = min, budget: int = 128 << 20):
        self.choose, self.budget = choose, budget
        self.root = _Node(b"")
        self.spills = 0

    def insert(self, key: bytes, owner: int, count: int = 1) -> None:
        node, at, path = self.root, 0, [self.root]
        added = 0
        while node.spilled is None:
            if at == len(key):
                node.owner = owner if node.count == 0 else self.choose(node.owner, owner)
                node.count += count
                break
            child = node.children.get(key[at])
            if child is None:
                leaf = _Node(key[at:])
                leaf.owner, leaf.count = owner, count
                added = leaf.weight = len(leaf.label) + NODE_BYTES
                node.children[key[at]] = leaf
                break
            label = child.label
            if key.startswith(label, at):
                at += len(label)
            else:
                child = self._split(node, child, _shared(label, key, at))
                added += NODE_BYTES
                at += len(child.label)
            node = child
            path.append(node)
        if node.spilled is not None:
            node.spilled.add(key[at:], owner, count)
        if added:
            for x in path:
                x.weight += added
            if self.root.weight > self.budget:
                self._spill()

    @staticmethod
    def _split(parent: _Node, child: _Node, n: int) -> _Node:
        upper = _Node(child.label[:n])
        upper.weight = child.weight
        parent.children[upper.label[0]] = upper
        child.label = child.label[n:]
        upper.children[child.label[0]] = child
        return upper

    def _spill(self) -> None:
        """Write out the heaviest subtree that holds at most half of all bytes."""
        node, path = self.root, []
        while node.weight > self.root.weight // 2 and node.children:
            path.append(node)
            node = max(node.children.values(), key=lambda x: x.weight)
        if not path:
            path, node = [], self.root
        spill = _Spill()
        for rest, owner, count in self._below(node, b""):
            spill.add(rest, owner, count)
        for x in path:
            x.weight -= node.weight
        node.children, node.owner, node.count, node.weight, node.spilled = {}, None, 0, 0, spill
        self.spills += 1

    def _below(self, top: _Node, prefix: bytes) -> Iterator[tuple[bytes, int, int]]:
        stack = [(top, prefix)]
        while stack:
            node, path = stack.pop()
            if node.count:
                yield path, node.owner, node.count
            if node.spilled is not None:
                for rest, owner, count in node.spilled.read():
                    yield path + rest, owner, count
            stack += [(child, path + child.label) for child in node.children.values()]

    def items(self) -> Iterator[tuple[bytes, int, int]]:
        """Each string once, with its owner and count."""
        stack = [(self.root, b"")]
        while stack:
            node, path = stack.pop()
            if node.count:
                yield path, node.owner, node.count
            if node.spilled is not None:
                inner = OwnerTrie(self.choose, self.budget)
                for rest, owner, count in node.spilled.read():
                    inner.insert(rest, owner, count)
                for rest, owner, count in inner.items():
                    yield path + rest, owner, count
            stack += [(child, path + child.label) for child in node.children.values()]
        self.root = _Node(b"")


def _shared(label: bytes, key: bytes, at: int) -> int:
    """Bytes that ``label`` and ``key[at:]`` share; they differ somewhere."""
    low, high = 0, min(len(label), len(key) - at)
    while low < high:  # the largest n with equal prefixes of n bytes
        mid = (low + high + 1) // 2
        if key.startswith(label[:mid], at):
            low = mid
        else:
            high = mid - 1
    return low
