"""A bounded store of values that were asked for lately."""

from __future__ import annotations


class Recent(dict):
    """Two generations of ``most`` entries each: when the young one is full it becomes the old one, and what
    is asked for there comes back.  Frequent keys stay whatever comes between."""

    def __init__(self, most: int) -> None:
        super().__init__()
        self.most = most
        self.old: dict = {}

    def found(self, keys: list) -> list:
        """The value of every key, or None."""
        out = list(map(self.get, keys))
        if None in out and self.old:
            old = self.old.get
            for i, value in enumerate(out):
                if value is None:
                    value = old(keys[i])
                    if value is not None:
                        out[i] = self[keys[i]] = value
        return out

    def add(self, values: dict) -> None:
        if len(self) + len(values) > self.most:
            self.old = dict(self)
            self.clear()
        self.update(values)
