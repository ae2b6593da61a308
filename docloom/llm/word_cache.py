"""A worker's memory of the ids of pieces of text, in two generations of bounded bytes."""

from __future__ import annotations

from collections.abc import Callable, Collection

#: Bytes of the pieces and their ids in each generation; the older one goes when the younger is full.
CACHE_BYTES = 64 << 20
#: What an entry takes besides the characters and ids.
ENTRY_BYTES = 200
#: Pieces that are worked out together.
STEP_PIECES = 20_000


class WordCache:
    """``ids_of`` gives the ids of a list of pieces (texts or their bytes), each as bytes; a piece is worked out once while it is remembered.
    Pieces that it leaves out are never kept: looking them up is a KeyError."""

    def __init__(self, ids_of: Callable[[list[str | bytes]], dict[str | bytes, bytes]], most: int | None = None):
        self.ids_of, self.most = ids_of, most or CACHE_BYTES
        self.young: dict[str | bytes, bytes] = {}
        self.older: dict[str | bytes, bytes] = {}
        self.held = 0

    def learn(self, pieces: Collection[str | bytes]) -> Callable[[str | bytes], bytes]:
        """-> a look-up that has ``pieces`` until the next call."""
        self._turn()
        young, older = self.young, self.older
        missing = [p for p in pieces if p not in young]
        if older:
            self._keep({p: older[p] for p in missing if p in older})
            missing = [p for p in missing if p not in young]
        for i in range(0, len(missing), STEP_PIECES):
            self._keep(self.ids_of(missing[i : i + STEP_PIECES]))
        return young.__getitem__

    def look_up(self, pieces: list[str | bytes], known: dict[str | bytes, bytes]) -> list[bytes]:
        """The ids of each of ``pieces``, no two of which are equal; those in ``known`` are neither asked for nor kept."""
        self._turn()
        found = list(map(self.young.get, pieces))
        missing = [i for i, ids in enumerate(found) if ids is None]
        for i in range(0, len(missing), STEP_PIECES):
            step = missing[i : i + STEP_PIECES]
            again = {p: self.older[p] for p in map(pieces.__getitem__, step) if p in self.older}
            self._keep(self.ids_of([p for p in map(pieces.__getitem__, step) if p not in again and p not in known]))
            self._keep(again)
            for k in step:
                p = pieces[k]
                found[k] = known[p] if p in known else self.young[p]
        return found

    def _turn(self) -> None:
        if self.held > self.most:
            self.older, self.young, self.held = self.young, {}, 0

    def _keep(self, found: dict[str | bytes, bytes]) -> None:
        self.young.update(found)
        self.held += 4 * sum(map(len, found)) + len(b"".join(found.values())) + ENTRY_BYTES * len(found)
