"""Deep-shallow sorting of byte strings: multikey quicksort on words of eight bytes to a shallow depth, then a blind trie
for each group that still ties, which holds the strings with long common prefixes."""

from __future__ import annotations

from collections.abc import Sequence

SHALLOW = 32
_WORD = 8


def common_prefix(a: bytes, b: bytes) -> int:
    n = min(len(a), len(b))
    differ = int.from_bytes(a[:n], "big") ^ int.from_bytes(b[:n], "big")
    return n - (differ.bit_length() + 7) // 8 if differ else n


class BlindTrie:
    """A trie whose inner nodes keep only a depth and the branching bytes; a leaf is a list of equal strings' numbers."""

    def __init__(self, strings: Sequence[bytes]):
        self.strings, self.root = strings, None

    def _byte(self, number: int, depth: int) -> int:
        s = self.strings[number]
        return s[depth] if depth < len(s) else -1

    def _any_leaf(self, node) -> int:
        while isinstance(node, tuple):
            node = next(iter(node[1].values()))
        return node[0]

    def add(self, number: int) -> None:
        if self.root is None:
            self.root = [number]
            return
        node = self.root
        while isinstance(node, tuple):  # blind descent: bytes between branches aren't looked at
            down = node[1].get(self._byte(number, node[0]))
            if down is None:
                break
            node = down
        other = self._any_leaf(node)
        depth = common_prefix(self.strings[number], self.strings[other])
        if len(self.strings[number]) == len(self.strings[other]) == depth:
            node.append(number)  # equal: the descent ended at its leaf
            return
        parent, edge, node = None, 0, self.root
        while isinstance(node, tuple) and node[0] < depth:
            parent, edge = node, self._byte(number, node[0])
            down = node[1].get(edge)
            if down is None:
                node[1][edge] = [number]
                return
            node = down
        if isinstance(node, tuple) and node[0] == depth:
            node[1][self._byte(number, depth)] = [number]
            return
        split = (depth, {self._byte(self._any_leaf(node), depth): node, self._byte(number, depth): [number]})
        if parent is None:
            self.root = split
        else:
            parent[1][edge] = split

    def in_order(self) -> list[int]:
        out: list[int] = []
        stack = [self.root] if self.root is not None else []
        while stack:
            node = stack.pop()
            if isinstance(node, tuple):
                stack.extend(node[1][b] for b in sorted(node[1], reverse=True))
            else:
                out.extend(node)
        return out


def deep_shallow_order(strings: Sequence[bytes], numbers: Sequence[int], shared: int = 0) -> list[int]:
    """numbers in the order of their strings; `shared` bytes at the start are known to be equal. A string sorts before its extensions."""
    out: list[int] = []
    stack = [(list(numbers), shared)]
    while stack:
        group, depth = stack.pop()
        if len(group) < 2:
            out.extend(group)
            continue
        if depth - shared >= SHALLOW:
            trie = BlindTrie(strings)
            for number in group:
                trie.add(number)
            out.extend(trie.in_order())
            continue
        words = [strings[k][depth : depth + _WORD] for k in group]
        pivot = sorted((words[0], words[len(words) // 2], words[-1]))[1]
        less = [k for k, w in zip(group, words, strict=True) if w < pivot]
        same = [k for k, w in zip(group, words, strict=True) if w == pivot]
        more = [k for k, w in zip(group, words, strict=True) if w > pivot]
        # Strings that end inside the pivot's word are equal: there is nothing left to look at.
        deeper = depth + _WORD if len(pivot) == _WORD else shared + SHALLOW
        stack += [(more, depth), (same, deeper), (less, depth)]
    return out
