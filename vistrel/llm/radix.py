"""A compressed radix (Patricia) trie over byte strings that spills whole subtrees to local files."""

from __future__ import annotations

import os
import pickle
import tempfile
from collections.abc import Callable, Iterator
from typing import Any

#: Bytes that a node costs besides its label.
NODE_BYTES = 240


def common_prefix(a: bytes, b: bytes) -> int:
    """Length of the longest common prefix, by doubling and then halving slices."""
    n = min(len(a), len(b))
    if a[:n] == b[:n]:
        return n
    step, low = 16, 0
    while a[low : low + step] == b[low : low + step]:
        low += step
        step *= 2
    high = min(n, low + step)
    while high - low > 1:
        mid = (low + high) // 2
        if a[low:mid] == b[low:mid]:
            low = mid
        else:
            high = mid
    return low if a[low : low + 1] != b[low : low + 1] else low + 1


class _Node:
    __slots__ = ("kids", "label", "spill", "value")

    def __init__(self, label: bytes, value: Any = None):
        self.label, self.value, self.kids, self.spill = label, value, {}, None


class RadixTrie:
    """Maps byte strings to merged values; at most about ``limit`` bytes stay in memory.

    ``merge(old, new)`` gives the value of a string that was inserted twice. When the limit is passed, the
    largest subtrees below the first branching node go to a file each; strings that later fall into such a
    subtree are appended to its file, and ``items`` rebuilds the subtrees one after the other, each under
    the same limit, so a subtree that is itself too large is split further down.
    """

    def __init__(self, merge: Callable[[Any, Any], Any], limit: int = 96 << 20):
        self.merge, self.limit, self.size = merge, limit, 0
        self.root, self.files = _Node(b""), []
        self.retry_at = limit

    def insert(self, key: bytes, value: Any) -> None:
        node, at = self.root, 0
        while True:
            if node.spill is not None:
                pickle.dump((key[at:], value), node.spill)
                return
            if at == len(key):
                node.value = value if node.value is None else self.merge(node.value, value)
                return
            kid = node.kids.get(key[at])
            if kid is None:
                node.kids[key[at]] = _Node(key[at:], value)
                self._grow(len(key) - at + NODE_BYTES)
                return
            if key.startswith(kid.label, at):
                node, at = kid, at + len(kid.label)
                continue
            k = common_prefix(kid.label, key[at : at + len(kid.label)])
            fork = _Node(kid.label[:k])
            kid.label = kid.label[k:]
            fork.kids[kid.label[0]] = kid
            node.kids[fork.label[0]] = fork
            self._grow(NODE_BYTES)
            node, at = fork, at + k

    def items(self) -> Iterator[tuple[bytes, Any]]:
        """All strings with their values; the trie is used up."""
        stack = [(self.root, b"")]
        while stack:
            node, above = stack.pop()
            here = above + node.label
            if node.spill is not None:
                yield from self._reread(node, here)
                continue
            if node.value is not None:
                yield here, node.value
            stack.extend((kid, here) for kid in node.kids.values())
        self.close()

    def close(self) -> None:
        for f in self.files:
            f.close()
        self.files = []

    def _grow(self, n: int) -> None:
        self.size += n
        if self.size > self.retry_at:
            self._spill()
            self.retry_at = max(self.limit, self.size + self.limit // 4)

    def _spill(self) -> None:
        branch = self.root
        while len(branch.kids) == 1 and branch.value is None and (only := next(iter(branch.kids.values()))).spill is None:
            branch = only
        sized = sorted(((self._bytes(kid), kid) for kid in branch.kids.values() if kid.spill is None), key=lambda x: -x[0])
        for n, kid in sized:
            if self.size <= self.limit // 2:
                break
            if not kid.kids:  # one string; a file would not make it smaller
                continue
            f = tempfile.TemporaryFile()
            self.files.append(f)
            for key, value in self._below(kid):
                pickle.dump((key, value), f)
            kid.kids, kid.value, kid.spill = {}, None, f
            self.size -= n - NODE_BYTES - len(kid.label)

    def _reread(self, node: _Node, here: bytes) -> Iterator[tuple[bytes, Any]]:
        inner = RadixTrie(self.merge, self.limit)
        node.spill.seek(0, os.SEEK_SET)
        while True:
            try:
                key, value = pickle.load(node.spill)
            except EOFError:
                break
            inner.insert(key, value)
        for key, value in inner.items():
            yield here + key, value

    @staticmethod
    def _bytes(top: _Node) -> int:
        n, stack = 0, [top]
        while stack:
            node = stack.pop()
            n += len(node.label) + NODE_BYTES
            stack.extend(node.kids.values())
        return n

    @staticmethod
    def _below(top: _Node) -> Iterator[tuple[bytes, Any]]:
        stack = [(top, b"")]
        while stack:
            node, above = stack.pop()
            if node.spill is not None:  # a fork above an older spilled subtree; its strings move on
                node.spill.seek(0, os.SEEK_SET)
                while True:
                    try:
                        key, value = pickle.load(node.spill)
                    except EOFError:
                        break
                    yield above + key, value
            if node.value is not None:
                yield above, node.value
            stack.extend((kid, above + kid.label) for kid in node.kids.values())
