"""An open-addressing table keyed by complete content."""

from __future__ import annotations


class ContentTable:
    """Linear probing over a power-of-two slot array; equal means equal bytes, not equal hash."""

    def __init__(self, capacity: int = 1024) -> None:
        self.mask = capacity - 1
        self.slots = [-1] * capacity
        self.hashes: list[int] = []
        self.contents: list[bytes] = []
        self.bytes = 0

    def __len__(self) -> int:
        return len(self.contents)

    def find_or_add(self, h: int, content: bytes) -> tuple[int, bool]:
        """The entry of content, and whether it is new."""
        slots, hashes, contents, mask = self.slots, self.hashes, self.contents, self.mask
        i = h & mask
        while (e := slots[i]) >= 0:
            if hashes[e] == h and contents[e] == content:
                return e, False
            i = (i + 1) & mask
        e = slots[i] = len(contents)
        hashes.append(h)
        contents.append(content)
        self.bytes += len(content) + 64
        if 2 * len(contents) > len(slots):
            self._grow()
        return e, True

    def _grow(self) -> None:
        self.slots = [-1] * (2 * len(self.slots))
        self.mask = len(self.slots) - 1
        for e, h in enumerate(self.hashes):
            i = h & self.mask
            while self.slots[i] >= 0:
                i = (i + 1) & self.mask
            self.slots[i] = e
