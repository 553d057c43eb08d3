"""Texts under many edits: pieces of bounded length in groups, so that an edit costs about the same wherever it falls and however long the text is."""

from __future__ import annotations

PIECE = 1024
GROUP = 64


class Rope:
    """A text as groups of pieces. Places are code points."""

    def __init__(self, pieces: list[str] | str = ""):
        pieces = [pieces] if isinstance(pieces, str) else pieces
        even = [p[i : i + PIECE] for p in pieces for i in range(0, len(p), PIECE)] or [""]
        self.groups = [even[i : i + GROUP] for i in range(0, len(even), GROUP)]
        self.sizes = [sum(map(len, g)) for g in self.groups]
        self.length = sum(self.sizes)

    def pieces(self) -> list[str]:
        return [p for g in self.groups for p in g]

    def text(self) -> str:
        return "".join(self.pieces())

    def _find(self, at: int) -> tuple[int, int, int]:
        """Group, piece and place within the piece; the end of a piece rather than the beginning of the next."""
        group = piece = 0
        while group < len(self.groups) - 1 and at > self.sizes[group]:
            at -= self.sizes[group]
            group += 1
        own = self.groups[group]
        while piece < len(own) - 1 and at > len(own[piece]):
            at -= len(own[piece])
            piece += 1
        return group, piece, at

    def cut(self, at: int, n: int) -> None:
        """Takes out n characters, which are there."""
        self.length -= n
        group, piece, at = self._find(at)
        while n:
            own = self.groups[group]
            if piece == len(own):
                group, piece = group + 1, 0
                continue
            k = min(n, len(own[piece]) - at)
            own[piece] = own[piece][:at] + own[piece][at + k :]
            self.sizes[group] -= k
            n -= k
            if own[piece] and (at or not n):
                piece, at = piece + 1, 0
            elif not own[piece]:
                del own[piece]
                at = 0
            if not own:
                del self.groups[group], self.sizes[group]
                piece = 0
        if not self.groups:
            self.groups, self.sizes = [[""]], [0]

    def insert(self, at: int, content: str) -> None:
        self.length += len(content)
        group, piece, at = self._find(at)
        own = self.groups[group]
        new = own[piece][:at] + content + own[piece][at:]
        own[piece : piece + 1] = [new] if len(new) <= 2 * PIECE else [new[i : i + PIECE] for i in range(0, len(new), PIECE)]
        self.sizes[group] += len(content)
        if len(own) > 2 * GROUP:
            halves = [own[i : i + GROUP] for i in range(0, len(own), GROUP)]
            self.groups[group : group + 1], self.sizes[group : group + 1] = halves, [sum(map(len, h)) for h in halves]

    def edit(self, action: str | None, start: int | None, end: int | None, content: str | None, client: bool = False) -> tuple[int, int, int]:
        """One edit: add inserts at start, update replaces [start, end), all else cuts it. Places are moved into the text; a null place is 0, a null content empty.

        ``client``: an add takes out [start, end) too, as browsers rebase it. Returns what it did: from, to, characters put in.
        """
        low = min(max(start or 0, 0), self.length)
        high = max(low, min(end or 0, self.length))
        if action == "add" and not client:
            high = low
        put = content or "" if action in ("add", "update") else ""
        if high > low:
            self.cut(low, high - low)
        if put:
            self.insert(low, put)
        return low, high, len(put)


def moved(place: int, low: int, high: int, put: int) -> int:
    """A place after another's edit of [low, high): it moves if the edit ended at or before it, and out of what was replaced to its begin."""
    return place + put - (high - low) if high <= place else min(place, low)
