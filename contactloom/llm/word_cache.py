"""A bounded memory of what each distinct word becomes, kept by the Python worker over its tasks."""

from __future__ import annotations


class WordCache(dict):
    """Maps words by ``make``; holds at most two generations of ``limit`` words, the recent ones."""

    def __init__(self, make, limit: int = 250_000):
        super().__init__()
        self.make, self.limit, self.old = make, limit, {}

    def __missing__(self, word):
        value = self.old.get(word)
        if value is None:
            value = self.make(word)
        self.put(word, value)
        return value

    def put(self, word, value) -> None:
        if len(self) >= self.limit:
            self.old = dict(self)
            self.clear()
        self[word] = value
