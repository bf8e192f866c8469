"""Lenient reading of JSON objects that a model wrote: only the format is repaired, never the content.

Used on the rows the JVM parser rejects, one string at a time inside Arrow batches. A text that does not parse is rewritten in
one forward pass over its tokens, with a stack of the open brackets, so the time grows with the length alone.
"""

import json
import re

_SPECIAL = re.compile(r'["\\\x00-\x1f]')
_BLANK = re.compile(r"[ \t\r\n]*")
_ATOM = re.compile(r"-?\d+(?:\.\d+)?(?:[eE][+-]?\d+)?|true|false|null")
_VALUE_START = set('"{[-0123456789tfn')


class _Writer:
    """Rewrites the object that starts at ``at``; ``text`` afterwards holds valid JSON or None."""

    def __init__(self, source: str, at: int):
        self.source, self.at, self.out, self.open = source, at, [], []
        self.key = False                    # whether the next string is a key
        self.named = False                  # whether a key has been written and its value not yet
        self.closable: tuple[int, str] | None = None
        self.text = self._run()

    def _run(self) -> str | None:
        while self.at < len(self.source):
            c = self.source[self.at]
            if c in " \t\r\n":
                self.at += 1
            elif c in "{[":
                self._start(c)
            elif c in "}]":
                if self._stop(c):
                    return "".join(self.out)
            elif c == ",":
                self._comma()
            elif c == ":":
                self.at += 1
            elif c == '"':
                self._string()
            else:
                atom = _ATOM.match(self.source, self.at)
                if not atom:
                    break                   # nothing that JSON knows: keep what came before
                self.out.append(atom.group())
                self.at = atom.end()
                self._done()
        return self._cut()

    def _cut(self) -> str | None:
        if self.closable is None:
            return None
        size, closers = self.closable
        return "".join(self.out[:size]) + closers

    def _start(self, c: str) -> None:
        if self.key:                        # a bracket where a key belongs: leave it out
            self.at += 1
            return
        self.out.append(c)
        self.open.append("}" if c == "{" else "]")
        self.at += 1
        self.key, self.named = c == "{", False
        self._mark()

    def _stop(self, c: str) -> bool:
        """Close down to the bracket that ``c`` belongs to; one that belongs to none is left out."""
        self.at += 1
        if c in self.open:
            self._retract()
            while self.open:
                last = self.open.pop()
                self.out.append(last)
                if last == c:
                    break
            self._done()
        return not self.open

    def _comma(self) -> None:
        self.at += 1
        if self.named:
            self._retract()                 # a key without a value
        elif self.out and self.out[-1] not in ("{", "[", ","):
            self.out.append(",")
        self.key = self.open[-1] == "}"

    def _retract(self) -> None:
        """Back to the last point where everything open could be closed."""
        del self.out[self.closable[0]:]
        self.named = False

    def _string(self) -> None:
        pieces, at = ['"'], self.at + 1
        while True:
            hit = _SPECIAL.search(self.source, at)
            pieces.append(self.source[at:hit.start() if hit else len(self.source)])
            if not hit:
                at, whole = len(self.source), False
                break
            c, at = hit.group(), hit.end()
            if c == "\\":
                if at < len(self.source):
                    nxt = self.source[at]
                    good = nxt in '"\\/bfnrt' or (nxt == "u" and re.fullmatch(r"[0-9A-Fa-f]{4}", self.source[at + 1:at + 5]))
                    pieces.append("\\" + nxt if good else "\\\\" + json.dumps(nxt)[1:-1])
                at += 1
            elif c != '"':
                pieces.append(json.dumps(c)[1:-1])
            elif self._ends(at):
                whole = True
                break
            else:
                pieces.append('\\"')        # a quote inside the text
        self.at = min(at, len(self.source))
        if self.key and not whole:
            return                          # a key cut short names nothing
        self.out.append("".join(pieces) + '"')
        if self.key:
            self.out.append(":")
            self.key, self.named = False, True
        else:
            self._done()

    def _ends(self, at: int) -> bool:
        """Whether a quote before ``at`` ends its string: what follows must be what may follow here."""
        at = _BLANK.match(self.source, at).end()
        if at == len(self.source):
            return True
        c = self.source[at]
        if self.key:
            return c in ":,}"
        if c in "}]":
            return True
        if c != ",":
            return False
        after = _BLANK.match(self.source, at + 1).end()
        if after == len(self.source):
            return True
        return self.source[after] in ('"}' if self.open[-1] == "}" else _VALUE_START | {"]"})

    def _done(self) -> None:
        """A value is complete."""
        self.key, self.named = False, False
        if self.open:
            self._mark()

    def _mark(self) -> None:
        self.closable = (len(self.out), "".join(reversed(self.open)))


def repair(raw: str | None) -> tuple[str | None, bool]:
    """(valid JSON text of the first object or None, whether its format had to be changed)."""
    source = (raw or "").rstrip()
    at = source.find("{")
    if at < 0:
        return None, False
    try:
        found, end = json.JSONDecoder().raw_decode(source, at)
        return json.dumps(found, ensure_ascii=False), False
    except (ValueError, RecursionError):
        pass
    fence = source.rfind("```")
    if fence > at and not source[fence + 3:].strip():
        source = source[:fence].rstrip()
    text = _Writer(source, at).text
    try:
        return (json.dumps(json.loads(text), ensure_ascii=False), True) if text else (None, False)
    except (ValueError, RecursionError):
        return None, False
