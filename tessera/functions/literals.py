"""Literals that every match of a regular expression must hold, and one expression that finds many of them in one pass."""

from __future__ import annotations

#: Shorter literals stand in too many texts to be worth a look.
LEAST = 3
ANY = None  # an item that says nothing about the text

Needs = frozenset | None


def best(options: list[Needs]) -> Needs:
    """Of sets of which a match holds a member each, the one whose shortest member is longest."""
    known = [o for o in options if o]
    return max(known, key=lambda o: (min(map(len, o)), -len(o)), default=None)


class Reader:
    """Reads a pattern from left to right: sequences of literals, groups, classes, and what repeats them."""

    def __init__(self, pattern: str):
        self.pattern, self.at = pattern, 0

    def peek(self, n: int = 1) -> str:
        return self.pattern[self.at : self.at + n]

    def take(self, n: int = 1) -> str:
        self.at += n
        return self.pattern[self.at - n : self.at]

    def alternatives(self) -> Needs:
        """Up to the end or a closing bracket: what one of the branches needs, if each needs something."""
        branches = [self.sequence()]
        while self.peek() == "|":
            self.take()
            branches.append(self.sequence())
        return frozenset().union(*branches) if all(branches) else None

    def sequence(self) -> Needs:
        options: list[Needs] = []
        run = ""
        while self.at < len(self.pattern) and self.peek() not in ("|", ")"):
            item = self.item()
            least, most = self.repeats()
            if isinstance(item, str) and least == most == 1:
                run += item
                continue
            if isinstance(item, str) and least:
                run += item  # once at least; what follows may be a repeat
            elif least and item:
                options.append(item)
            options.append(frozenset([run]))
            run = ""
        return best([*options, frozenset([run])])

    def item(self) -> str | Needs:
        c = self.take()
        if c == "(":
            ahead = self.peek(2) if self.peek() == "?" else ""
            if ahead:
                self.take(2)
                if ahead == "?<" and self.peek() in ("=", "!"):
                    ahead += self.take()
                elif ahead == "?<":
                    self.take(self.pattern.index(">", self.at) - self.at + 1)
            inner = self.alternatives()
            self.take()
            return ANY if ahead in ("?=", "?!", "?<=", "?<!") else inner
        if c == "[":
            if self.peek() == "^":
                self.take()
            if self.peek() == "]":
                self.take()
            while self.peek() != "]":
                self.take(2 if self.peek() == "\\" else 1)
            self.take()
            return ANY
        if c == "\\":
            c = self.take()
            return ("" if c in "bB" else ANY) if c.isalnum() else c
        return "" if c in "^$" else ANY if c == "." else c

    def repeats(self) -> tuple[int, float]:
        c = self.peek()
        found = {"*": (0, float("inf")), "+": (1, float("inf")), "?": (0, 1)}.get(c)
        if found:
            self.take()
        elif c == "{":
            inside = self.take(self.pattern.index("}", self.at) - self.at + 1)[1:-1].split(",")
            found = int(inside[0] or 0), int(inside[-1]) if inside[-1] else float("inf")
        else:
            return 1, 1
        if self.peek() in ("?", "+"):  # as few, or as many, as can be
            self.take()
        return found


def required(pattern: str) -> Needs:
    """Literals (lower case) of which every match of the pattern holds one; None where none of LEAST characters or more is sure."""
    found = Reader(pattern).alternatives()
    return frozenset(x.lower() for x in found) if found and min(map(len, found)) >= LEAST else None


def quoted(text: str) -> str:
    return "".join(c if c.isalnum() or c in "_ \n" else f"\\{c}" for c in text)


def trie(literals: frozenset[str]) -> str:
    """An expression for the longest of the literals at a place: branches part at their first different character."""
    by_first: dict[str, set[str]] = {}
    for x in literals:
        if x:
            by_first.setdefault(x[0], set()).add(x[1:])
    branches = []
    for first, rest in sorted(by_first.items()):
        tail = trie(frozenset(rest))
        branches.append(quoted(first) + (f"(?:{tail})?" if tail and "" in rest else f"(?:{tail})" if "|" in tail else tail))
    return "|".join(branches)


def finder(literals: frozenset[str]) -> str:
    """An expression whose first group is, at each place of a text, the longest literal that begins there."""
    firsts = "".join(sorted({quoted(x[0]) for x in literals}))
    return f"(?=[{firsts}])(?=({trie(literals)}))"
