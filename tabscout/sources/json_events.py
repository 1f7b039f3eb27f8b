"""Large JSON objects read piece by piece, so that no file has to be one row or one string."""
from __future__ import annotations

import json
from collections.abc import Iterator

CHUNK = 1 << 16
_SPACE = " \t\n\r"
_decoder = json.JSONDecoder()


class Events:
    """The members of a JSON object, and of one object inside it, in the order of the file."""

    def __init__(self, stream):
        self.stream, self.buffer, self.at, self.ended, self.step = stream, "", 0, False, CHUNK
        self.largest = 0  # characters held at once

    def _more(self) -> bool:
        piece = "" if self.ended else self.stream.read(self.step)
        self.ended = not piece
        self.buffer, self.at = self.buffer[self.at:] + piece, 0
        self.largest = max(self.largest, len(self.buffer))
        return not self.ended

    def _peek(self) -> str:
        """The next character that is not white space, '' at the end."""
        while True:
            while self.at < len(self.buffer) and self.buffer[self.at] in _SPACE:
                self.at += 1
            if self.at < len(self.buffer):
                return self.buffer[self.at]
            if not self._more():
                return ""

    def _take(self, wanted: str) -> str:
        found = self._peek()
        if not found or found not in wanted:
            raise ValueError(f"{found or 'end of file'!r} instead of one of {wanted!r}")
        self.at += 1
        return found

    def value(self):
        """The next value as a whole; reads twice as much each time it does not end in what is held."""
        self._peek()
        self.step = CHUNK
        while True:
            try:
                found, end = _decoder.raw_decode(self.buffer, self.at)
                if end < len(self.buffer) or self.ended or isinstance(found, (str, list, dict)):
                    self.at, self.step = end, CHUNK
                    return found
            except ValueError:
                if self.ended:
                    raise
            self.step = max(CHUNK, len(self.buffer) - self.at)
            self._more()

    def members(self) -> Iterator[str]:
        """Keys of the object that comes next; the caller takes each value."""
        self._take("{")
        if self._peek() == "}":
            self._take("}")
            return
        while True:
            key = self.value()
            if not isinstance(key, str):
                raise ValueError("a key that is no text")
            self._take(":")
            yield key
            if self._take(",}") == "}":
                return


def read_object(stream, inside: str) -> Iterator[tuple[str, str | None, str]]:
    """(key, inner key, JSON text) of a top-level object; the members of ``inside`` come one by one.

    ``stream`` gives text. What cannot be parsed raises ValueError where it is met.
    """
    events = Events(stream)
    for key in events.members():
        if key == inside and events._peek() == "{":
            for inner in events.members():
                yield key, inner, json.dumps(events.value())
        else:
            yield key, None, json.dumps(events.value())
    if events._peek():
        raise ValueError("text after the end")
