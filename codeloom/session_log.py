"""Code that a session has shown: where a span is remembered, and where it is looked for again."""

from typing import NamedTuple

from codeloom import constants as C


class Span(NamedTuple):
    turn: int
    name: str
    path: str
    first: int
    last: int

    def reference(self) -> str:
        return C.BACK_REFERENCE % (self.name, self.turn, self.first, self.last)


def asked(key: str | None, path: str | None, first: int, last: int) -> list[str]:
    """Slots in which a request is looked for, the first one that holds a span counts."""
    return ([f"symbol {key}"] if key else []) + ([f"range {path} {first} {last}"] if path else [])


def written(key: str | None, name: str | None, path: str | None, first: int, last: int) -> set[str]:
    """Slots that a shown span fills: those in which it can be asked for, and its bare name."""
    return {*asked(key, path, first, last), *asked(name, None, first, last)}


class SessionLog:
    """Spans of one interactive session by slot."""

    def __init__(self):
        self.clear()

    def clear(self) -> None:
        self.turn = 1
        self.spans: dict[str, Span] = {}

    def next_turn(self) -> int:
        self.turn += 1
        return self.turn

    def record(self, row) -> None:
        place = row["path"], row["start_line"], row["end_line"]
        span = Span(self.turn, row["name"], *place)
        self.spans.update(dict.fromkeys(written(row["symbol_key"], row["name"], *place), span))

    def find(self, row) -> Span | None:
        """The span that an earlier turn showed for a symbol, if the last one it was shown in is earlier."""
        slots = asked(row["symbol_key"], row["path"], row["start_line"], row["end_line"])
        return next((s if s.turn < self.turn else None for s in map(self.spans.get, slots) if s), None)

    def earlier(self, path: str) -> list[tuple[str, str]]:
        """(symbol key or name, reference) of a file's symbols shown before this turn."""
        return [(slot.removeprefix("symbol "), s.reference()) for slot, s in self.spans.items()
                if slot.startswith("symbol ") and s.path == path and s.turn < self.turn]
